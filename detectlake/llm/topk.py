"""Exact top-k search by inner product with no-random-access (NRA) aggregation.

Each dimension has a block's rows in a list sorted by value, and a query reads all lists in step from the
ends that its signs favour. What was read of a row so far gives a lower and an upper bound of its score.
Rows that no list has shown can't qualify once the lists' frontiers are too low; shown ones are dropped as
their upper bounds fall below the k-th best lower bound. Reading goes on for those that remain until their
last entries are met, which resolves their scores. No row is ever looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Method, norms, search_blocks
from .common import table

#: What rounding can make of a sum of products, as a share of the norms' product; bounds are wider by it.
ROUNDING = 1e-11
#: Whole numbers below it add up exactly in doubles, and in longs below the other.
DOUBLE, LONG = float(2**53), float(2**62)


class ExactProducts:
    """Exact inner products of whole numbers held as doubles: in longs where they fit, else in Python's integers."""

    def __init__(self, rows: np.ndarray, square: np.ndarray):
        self.rows, self.norm, self.small = rows, np.sqrt(square), self.longs(rows)

    @staticmethod
    def longs(values: np.ndarray) -> np.ndarray:
        return np.where(np.abs(values) < LONG, values, 0).astype(np.int64)

    def __call__(self, which: np.ndarray, query: np.ndarray) -> np.ndarray | list[int]:
        """The products of some rows with a query; a list if there is one that longs may not hold."""
        with np.errstate(over="ignore", invalid="ignore"):
            wide = ~(self.norm[which] * np.sqrt((query.astype(np.float64) ** 2).sum()) < LONG)
        fits = self.small[which] @ self.longs(query)
        if not wide.any():
            return fits
        whole = [int(x) for x in query.tolist()]
        return [sum(int(x) * y for x, y in zip(self.rows[i].tolist(), whole, strict=True)) if w else s for i, w, s in zip(which.tolist(), wide.tolist(), fits.tolist(), strict=True)]


class SortedLists:
    """The sorted lists of one block of rows, each entry with its row's number."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, most: float):
        self.ids, self.rows, self.norm = ids, rows, norms(rows)
        self.entry = np.ascontiguousarray(np.argsort(-rows, axis=0, kind="stable").T)
        self.value = np.take_along_axis(np.ascontiguousarray(rows.T), self.entry, 1)
        with np.errstate(over="ignore"):
            self.square = (rows**2).sum(1)
        self.usual = float(np.median(self.norm))

    def depths(self) -> list[int]:
        """Where reading stops to look at bounds: at 1, 2, 4 ... entries, then after each sixteenth of the lists."""
        n = len(self.rows)
        step = max(1, n // 16)
        return [*(1 << i for i in range(step.bit_length() - 1)), *range(step, n, step), n]

    def read(self, up: np.ndarray, down: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and values of entries ``a`` to ``b`` of the lists ``up``, from the top, and ``down``, from the bottom; a list is a row."""
        n = len(self.rows)
        return tuple(np.concatenate([x[up, a:b], x[down, n - b : n - a]]) for x in (self.entry, self.value))

    def frontier(self, query: np.ndarray, at: int) -> float:
        """The most that entries from depth ``at`` on can add up to in all lists together."""
        if at >= len(self.rows):
            return 0.0
        ahead = np.where(query > 0, self.value[:, at], self.value[:, len(self.rows) - 1 - at]) * query
        return float(ahead[ahead > 0].sum())

    def best(self, own: int, query: np.ndarray, bar: float, k: int) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """Numbers and exact scores of the rows that may be among the k best and reach the bar.

        A row's score lies below what was seen of it plus what the lists' frontiers can add. While there is
        no bar, it also lies within |x||q| over the unread entries of what was seen, and that is at most
        (c |x|^2 + |q|^2 / c) / 2 for any c > 0: a sum over entries, of which reading takes its part off. The
        k-th of these lower bounds is a bar.
        """
        n, length, whole = len(self.rows), float(norms(query[None])[0]), float((query**2).sum())
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        weight = query[np.concatenate([up, down])][:, None]
        c = length / self.usual if length > 0 and self.usual > 0 else 1.0
        slack = ROUNDING * (c * self.square + whole / c)
        learn = bar == -np.inf
        rest = (c * self.square + whole / c) / 2 if learn else None  # the bound of what is unread
        live, place, at = np.arange(n), None, 0
        seen, mine = np.zeros(n), self.ids == own
        top, others = float(self.norm.max()), n - int(mine.sum())
        for to in self.depths():
            row, value = self.read(up, down, at, to)
            add = [value * weight] + ([(c / 2) * value * value + weight * weight / (2 * c)] if learn else [])
            row, at = row.ravel(), to
            if place is not None:
                row = place[row]
                known = np.flatnonzero(row >= 0)
                row, add = row[known], [x.ravel()[known] for x in add]
            seen += np.bincount(row, add[0].ravel(), len(live))
            frontier = self.frontier(query, at)
            upper = seen + slack + frontier
            if learn:
                rest -= np.bincount(row, add[1].ravel(), len(live))
                ahead = np.maximum(rest, 0) if at < n else np.zeros(len(live))
                lower, upper = seen - ahead - slack, np.minimum(upper, seen + ahead + slack)
                lower = np.where(mine | np.isnan(lower), -np.inf, lower)
                if others >= k:
                    bar = max(bar, float(np.partition(lower, len(live) - k)[len(live) - k]))
            floor = bar - ROUNDING * abs(bar) - 0.5
            keep = ~(upper < floor) & ~mine
            if at < n and not min(frontier, length * top) + ROUNDING * length * top < floor:
                keep |= (seen == 0) & ~mine  # a row that no list has shown may qualify yet
            left = int(keep.sum())
            # from here on entries of other rows are passed over
            if left < 0.7 * len(live) or (at >= n and left < len(live)):
                live, slack, seen, mine = (x[keep] for x in (live, slack, seen, mine))
                rest = rest[keep] if learn else None
                if not len(live):
                    break
                place = np.full(n, -1)
                place[live] = np.arange(len(live))
                others = len(live)
        if not length * float(self.norm[live].max(initial=0.0)) < DOUBLE:
            return live, ExactProducts(self.rows, self.square)(live, query)
        return live, np.rint(seen).astype(np.int64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best rows for each query that reach its bar; ties go to smaller ids.

        Fails if the score of one of them doesn't fit a long.
        """
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            for j, q in enumerate(queries):
                live, exact = self.best(query_ids[j], q, float(bars[j]), k)
                if isinstance(exact, list):
                    order = np.array(sorted(range(len(exact)), key=lambda i: (-exact[i], self.ids[live[i]]))[:k], np.int64)
                    scores = np.array([exact[i] for i in order], np.int64)
                else:
                    order = np.lexsort((self.ids[live], -exact))[:k]
                    scores = exact[order]
                out.append((np.full(len(order), j), self.ids[live[order]], scores))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def most_in_boxes(queries: np.ndarray, most: float, floor: np.ndarray, roof: np.ndarray) -> np.ndarray:
    """Upper bounds of the products of queries (first axis) with rows of boxes (second); the last dimension is the norm."""
    with np.errstate(over="ignore", invalid="ignore"):
        box = np.maximum(queries, 0) @ roof[:, :-1].T + np.minimum(queries, 0) @ floor[:, :-1].T
        far = norms(queries)[:, None] * roof[:, -1]
    return np.minimum(np.nan_to_num(box, nan=np.inf), far) + ROUNDING * far + 0.5


METHOD = Method(points=lambda rows, most: np.column_stack([rows, norms(rows)]), reach=most_in_boxes, index=SortedLists, score=(pa.int64(), "long"))


def exact_topk(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = 16_384, query_rows: int = 65_536) -> DataFrame:
    """The k rows with the largest integer inner product for each query row.

    Components are floor(scale * x), x as double. Queries are the rows whose id is divisible by
    ``query_every``; candidates are all rows with another id, ties to smaller ids. Rows whose id or vector is
    null, or whose vector holds a null or a non-finite component, take no part; only vectors of equal length
    meet. Products are exact whatever the size of components; a score among the k best of a block that
    doesn't fit a long fails the job, as it would in SQL. Repeated rows count each for
    itself. Fewer candidates than k give fewer rows; an empty table gives none.
    """
    x = F.transform(embedding, lambda v: v.cast("double"))
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # whole numbers as doubles, which hold them exactly: from 2^53 on a double has no fraction
    whole = lambda v: F.when(F.abs(v * scale) < 2**53, F.floor(v * scale).cast("double")).otherwise(v * scale)
    scaled = vectors.where(usable).where(fine).select(F.col(vec_id).alias("vec_id"), F.transform(x, whole).alias("v"))
    return search_blocks(scaled, F.col("vec_id") % query_every == 0, k, METHOD, block_rows, query_rows)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs of query and candidate.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
