"""Hard-negative mining with angular triangle filtering.

Every row stores its angles to a few reference directions and its norm. By the triangle inequality on the
sphere, the angle between two rows lies between the difference and the sum of their angles to any reference;
that gives an interval of cosines, and times the norms an interval of scores, widened by what rounding can
do. Rows lie in blocks by their nearest reference and their angle to it. An anchor goes only to blocks, and
is scored, in whole numbers, only with rows whose interval overlaps the window that it looks into: from the
best scores so far upwards for positives, between a share of a positive's score and that score for negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import by_dim, norms
from .common import materialise, table
from .topk import DOUBLE, ExactProducts

#: Reference directions, chosen from so many rows by the order of a hash. Every row has its angle to each.
REFERENCES, SAMPLE_ROWS = 32, 4_096
#: Equal parts of the angle to the nearest reference in which rows are counted to cut them into leaves, and leaves at most.
ANGLE_PARTS, LEAVES = 4_096, 4_096
#: What rounding can make of an angle (an arc cosine near 1 loses half of the digits) and of a score, as a share of the norms' product.
ANGLE_SLACK, SCORE_SLACK = 1e-7, 1e-11
#: References that are looked at together when a block's rows are filtered, and the share of rows left above which no more are.
AT_ONCE, USELESS = 8, 0.9


def units(rows: np.ndarray) -> np.ndarray:
    norm = norms(rows)
    return rows / np.where(norm > 0, norm, 1.0)[:, None]


def spread_references(sample: np.ndarray) -> np.ndarray:
    """Unit vectors of up to REFERENCES rows, each the one farthest in angle from those before it."""
    unit = units(sample)
    unit = unit[np.abs(unit).max(1) > 0] if len(unit) else unit
    if not len(unit):
        return np.eye(1, sample.shape[1])
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < REFERENCES and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def angles_to(rows: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to references; a row of zeros, whose scores are all zero, counts as at a right angle."""
    return np.arccos(np.clip(units(rows) @ references.T, -1.0, 1.0))


@dataclass(frozen=True)
class Leaves:
    """What is known of each leaf of the rows of one vector length: ends of its angles to references and of its norms."""

    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def scores(self, angles: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the highest score of any row of each leaf (second axis) with queries (first axis)."""
        near, far = np.zeros((len(angles), len(self.leaf))), np.full((len(angles), len(self.leaf)), np.pi)
        for r in range(angles.shape[1]):
            own = angles[:, r : r + 1]
            near = np.maximum(near, np.maximum(self.low[:, r] - own, own - self.high[:, r]))
            far = np.minimum(far, np.minimum(own + self.high[:, r], 2 * np.pi - own - self.low[:, r]))
        best, worst = np.cos(np.maximum(near - ANGLE_SLACK, 0)), np.cos(np.minimum(np.maximum(far, near) + ANGLE_SLACK, np.pi))
        with np.errstate(over="ignore"):
            scale = norm[:, None]
            slack = SCORE_SLACK * scale * self.most + 0.5
            return scale * worst * np.where(worst > 0, self.least, self.most) - slack, scale * best * np.where(best > 0, self.most, self.least) + slack


def widest(score: float, length: float, norm: float) -> float:
    """The angle beyond which no row of that norm, or a shorter one, reaches a score; pi if all do."""
    if not score > 0:
        return np.pi
    return float(np.arccos(min(1.0, score / (length * norm)))) + ANGLE_SLACK if length * norm > 0 else 0.0


class Block:
    """The rows of one block, in the order of their angle to the reference nearest to all of them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, angles: np.ndarray, cell: int):
        order = np.argsort(angles[:, cell], kind="stable")
        self.ids, self.labels, self.rows, self.angles, self.cell = ids[order], labels[order], rows[order], angles[order], cell
        self.own = self.angles[:, cell].copy()
        self.norm = norms(self.rows)
        self.most, self.least = float(self.norm.max(initial=0.0)), float(self.norm.min(initial=np.inf))
        with np.errstate(over="ignore"):
            self.exact = ExactProducts(self.rows, (self.rows**2).sum(1)) if not self.most**2 < DOUBLE else None

    def overlapping(self, angles: np.ndarray, length: float, floor: float, roof: float) -> np.ndarray:
        """Numbers of the rows whose interval of scores overlaps [floor, roof], by the references looked at."""
        reach = widest(floor - 0.5 - SCORE_SLACK * length * self.most, length, self.most)
        # rows within this angle of the anchor have scores above the roof
        inside = widest(roof + 0.5 + SCORE_SLACK * length * self.most, length, self.least) - 2 * ANGLE_SLACK if 0 < roof < np.inf else 0.0
        own = angles[self.cell]
        found = np.arange(*np.searchsorted(self.own, [own - reach - ANGLE_SLACK, own + reach + ANGLE_SLACK])) if reach < np.pi else np.arange(len(self.ids))
        for at in range(0, len(angles), AT_ONCE):
            if not len(found):
                break
            theirs, mine = self.angles[found, at : at + AT_ONCE], angles[at : at + AT_ONCE]
            fits = np.abs(theirs - mine).max(1) <= reach + ANGLE_SLACK
            if inside > 0:
                fits &= (theirs + mine).min(1) >= inside - ANGLE_SLACK
            left = int(fits.sum())
            useless = left > USELESS * len(found)
            found = found[fits]
            if useless:
                break
        return found

    def scores(self, found: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
        """Exact scores of some rows; fails if one doesn't fit a long."""
        if length * self.most < DOUBLE:
            return np.rint(self.rows[found] @ query).astype(np.int64)
        exact = self.exact or ExactProducts(self.rows, (self.rows**2).sum(1))
        return np.array(exact(found, query), np.int64)


def best_same(block: Block, own: int, label: int, query: np.ndarray, angles: np.ndarray, bar: float, k: int) -> list[tuple[int, int, int]]:
    """(0, id, score) of the k best other rows of the same label that reach the bar."""
    length = float(norms(query[None])[0])
    found = block.overlapping(angles, length, bar, np.inf)
    found = found[(block.labels[found] == label) & (block.ids[found] != own)]
    score = block.scores(found, query, length)
    order = np.lexsort((block.ids[found], -score))[:k]
    return [(0, i, s) for i, s in zip(block.ids[found[order]].tolist(), score[order].tolist(), strict=True)]


def best_other(block: Block, label: int, query: np.ndarray, angles: np.ndarray, tops: list[int], bars: list[int | None], share: int, k: int) -> list[tuple[int, int, int]]:
    """(number of the window, id, score) of the k best rows of other labels in each window.

    A window holds the scores from ``share`` percent of its top up to its top; a bar, if there is one, is a
    score below which nothing is wanted.
    """
    length = float(norms(query[None])[0])
    floors = [max(-(-share * top // 100), bar if bar is not None else -(2**63)) for top, bar in zip(tops, bars, strict=True)]
    live = [w for w in range(len(tops)) if floors[w] <= tops[w]]
    if not live:
        return []
    found = block.overlapping(angles, length, float(min(floors[w] for w in live)), float(max(tops[w] for w in live)))
    found = found[block.labels[found] != label]
    score = block.scores(found, query, length)
    some = (score <= max(tops[w] for w in live)) & (score >= min(floors[w] for w in live))
    found, score = found[some], score[some]
    order = np.lexsort((block.ids[found], -score))
    ids, score = block.ids[found[order]], score[order]
    out = []
    for w in live:
        at, end = np.searchsorted(-score, -tops[w], "left"), np.searchsorted(-score, -floors[w], "right")
        out += [(w, i, s) for i, s in zip(ids[at : min(end, at + k)].tolist(), score[at : min(end, at + k)].tolist(), strict=True)]
    return out


def leaf_table(dealt: DataFrame, block_rows: int) -> DataFrame:
    """(dim, cell, part, leaf, first, blocks): the leaf of each part of a cell's angles, and the numbers of its blocks.

    Parts of a cell in order of angle make up a leaf until it has a block's rows (more, so that there are at
    most LEAVES leaves and as many cells); a part with more rows is a leaf of several blocks.
    """
    counted = dealt.groupBy("dim", "cell", "part").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["dim", "cell", "part"])
    rows, block = [], 0
    for dim, of_dim in counted.groupby("dim"):
        enough, leaf = max(block_rows, -(-int(of_dim["n"].sum()) // LEAVES)), 0
        for cell, own in of_dim.groupby("cell"):
            parts, held = [], 0

            def close(dim: int = int(dim), cell: int = int(cell)) -> None:
                nonlocal parts, held, leaf, block
                blocks = -(-held // block_rows)
                rows.extend((dim, cell, part, leaf, block, blocks) for part in parts)
                parts, held, leaf, block = [], 0, leaf + 1, block + blocks

            for part, n in zip(own["part"].tolist(), own["n"].tolist(), strict=True):
                if held and held + n > enough:
                    close()
                parts.append(part)
                held += n
            close()
    return dealt.sparkSession.createDataFrame(rows, "dim int, cell int, part int, leaf int, first long, blocks long")


def known_leaves(rows: DataFrame) -> dict[int, Leaves]:
    """What is known of the leaves, from rows (dim, leaf, angles, v): as many rows to the driver as leaves have references."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for dim, own, v in by_dim([batch], "v"):
                told = np.column_stack([own.column("angles").flatten().to_numpy().reshape(len(own), -1), norms(v)])
                leaves = own.column("leaf").to_numpy()
                for leaf in np.unique(leaves).tolist():
                    mine = told[leaves == leaf]
                    low, high = found.get((dim, leaf), (np.inf, -np.inf))
                    found[dim, leaf] = [np.minimum(low, mine.min(0)), np.maximum(high, mine.max(0))]
        for (dim, leaf), (low, high) in found.items():
            at = np.arange(len(low), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(at), dim, np.int32), np.full(len(at), leaf, np.int32), at, low, high)], ["dim", "leaf", "at", "low", "high"])

    told = rows.select("dim", "leaf", "angles", "v").mapInArrow(ends, "dim int, leaf int, at int, low double, high double").groupBy("dim", "leaf", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out = {}
    for dim, own in told.toPandas().sort_values(["dim", "leaf", "at"]).groupby("dim"):
        leaf = own["leaf"].unique()
        low, high = (own[c].to_numpy().reshape(len(leaf), -1) for c in ("low", "high"))
        out[int(dim)] = Leaves(leaf, low[:, :-1], high[:, :-1], low[:, -1], high[:, -1])
    return out


@dataclass(frozen=True)
class Search:
    """Placed rows (block, cell, vec_id, label, v, angles) and what leads anchors to them."""

    placed: DataFrame
    leaves: dict[int, Leaves]
    of_leaf: DataFrame
    query_rows: int

    def visit(self, asked: DataFrame, nearest: bool, look: Callable[[Block, dict, np.ndarray, np.ndarray], list[tuple[int, int, int]]]) -> DataFrame:
        """(row, window, vec_id, score) that anchors find in the one leaf that promises most, or in all others that can matter.

        ``asked``: row, dim, vec_id, label, v, angles, tops (scores that windows end at, none for no end) and
        bars (scores below which nothing is wanted). Rows of a block come first in a task, anchors stream past them.
        """
        leaves = self.leaves

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for dim, own, v in by_dim(batches, "v"):
                known, angles, length = leaves[dim], own.column("angles").flatten().to_numpy().reshape(len(own), -1), norms(v)
                tops, bars = own.column("tops").to_pylist(), own.column("bars").to_pylist()
                roof = np.array([max(t, default=np.inf) for t in tops], float)
                floor = np.array([min(b, default=-np.inf) for b in bars], float)
                for at in range(0, len(own), 64):
                    low, high = known.scores(angles[at : at + 64], length[at : at + 64])
                    best = np.minimum(high, roof[at : at + 64, None]).argmax(1)
                    if nearest:
                        q, leaf = np.arange(len(best)), best
                    else:
                        fits = (high >= floor[at : at + 64, None]) & (low <= roof[at : at + 64, None])
                        fits[np.arange(len(best)), best] = False
                        q, leaf = np.nonzero(fits)
                    yield pa.RecordBatch.from_arrays([own.column("row").take(pa.array(q + at)), pa.array(np.full(len(q), dim, np.int32)), pa.array(known.leaf[leaf].astype(np.int32))], ["row", "dim", "leaf"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, block = None, [], None
            for batch in batches:
                blocks, parts, kinds = (batch.column(i).to_numpy() for i in range(3))
                edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                    if a == b:
                        continue
                    if (blocks[a], parts[a]) != key:
                        key, held, block = (blocks[a], parts[a]), [], None
                    own = batch.slice(a, b - a)
                    ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
                    v, angles = (own.column(c).flatten().to_numpy().reshape(b - a, -1) for c in ("v", "angles"))
                    if not kinds[a]:
                        held.append((ids, labels, v, angles))
                        cell = int(own.column("cell")[0].as_py())
                        continue
                    if block is None and held:
                        block, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True)), cell), []
                    if block is None:
                        continue
                    found, rows, told = [], own.column("row").to_pylist(), own.select(["tops", "bars"]).to_pylist()
                    for j in range(b - a):
                        found += [(rows[j], *x) for x in look(block, told[j] | {"vec_id": int(ids[j]), "label": int(labels[j])}, v[j], angles[j])]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["row", "window", "vec_id", "score"])

        ways = asked.select("row", "dim", "v", "angles", "tops", "bars").mapInArrow(route, "row long, dim int, leaf int").join(F.broadcast(self.of_leaf), ["dim", "leaf"])
        ways = materialise(ways.select("row", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("block")), "ways")
        parts = ways.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / self.query_rows).alias("parts"))
        nothing = F.array().cast("array<long>")
        columns = ["vec_id", "label", "cell", "v", "angles", "tops", "bars"]
        sides = self.placed.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "row", *columns[:5], nothing.alias("tops"), nothing.alias("bars"))
        asks = ways.join(asked.withColumn("cell", F.lit(-1)), "row").join(parts, "block").select("block", F.pmod(F.xxhash64("row"), "parts").alias("part"), F.lit(1).alias("kind"), "row", *columns)
        both = sides.unionByName(asks).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
        return materialise(both.mapInArrow(meet, "row long, window int, vec_id long, score long"), "seen")


def hard_negatives(vectors: DataFrame, k: int = 5, anchor_every: int = 100, shift_every: int = 7, labels: int = 10, scale: int = 256, share: int = 80, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block_rows: int = 16_384, query_rows: int = 65_536) -> DataFrame:
    """The hardest negatives of each anchor and positive.

    Components are floor(scale * x), x as double; a score is an integer inner product, higher ones first, ties
    to smaller ids. Anchors are the rows whose id is divisible by ``anchor_every``, its positives the first
    k rows of its label with another id; where an id is divisible by ``shift_every``, the label first becomes
    (label + 1) % ``labels``. Negatives are the first k rows of other labels that score between ``share``
    percent of the positive's score and all of it. Returns anchor_id, positive_id, rank, negative_id,
    positive_score and negative_score; a positive without such rows gives none. Rows whose id, label or vector
    is null, or whose vector is empty or holds a null or a non-finite component, take no part; only vectors of equal
    length meet; repeated rows count each for itself. An empty table gives no rows. Scores are exact; one
    that is looked at and doesn't fit a long fails the job, as it would in SQL.
    """
    spark = vectors.sparkSession
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v * scale) < 2**53, F.floor(v * scale).cast("double")).otherwise(v * scale)
    there = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0)
    own_label = F.when(F.col(vec_id) % shift_every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label)).cast("long")
    rows = vectors.where(there).where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), own_label.alias("label"), F.transform(x, whole).alias("v"), F.size(embedding).alias("dim"), F.monotonically_increasing_id().alias("row"))
    stored = materialise(rows, "vectors")
    sample: dict[int, list] = {}
    for r in stored.select("dim", "row", "v").orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).toLocalIterator():
        sample.setdefault(r.dim, []).append(r.v)
    if not sample:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    references = {dim: spread_references(np.array(v, np.float64)) for dim, v in sample.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, v in by_dim(batches, "v"):
            to = references[dim] if dim in references else np.eye(1, dim)  # a length that the sample hasn't met
            angles = angles_to(v, to)
            cell = angles.argmin(1)
            part = np.minimum((angles[np.arange(len(v)), cell] * (ANGLE_PARTS / np.pi)).astype(np.int32), ANGLE_PARTS - 1)
            for name, made in (("angles", pa.array(list(angles), pa.list_(pa.float64()))), ("cell", pa.array(cell.astype(np.int32))), ("part", pa.array(part))):
                own = own.append_column(name, made)
            yield own

    dealt = materialise(stored.mapInArrow(deal, "vec_id long, label long, v array<double>, dim int, row long, angles array<double>, cell int, part int"), "dealt")
    of_part = leaf_table(dealt, block_rows)
    leaved = dealt.join(F.broadcast(of_part), ["dim", "cell", "part"])
    placed = leaved.select((F.col("first") + F.pmod(F.xxhash64("row"), "blocks")).alias("block"), "cell", "row", "vec_id", "label", "v", "angles")
    search = Search(placed, known_leaves(leaved), of_part.select("dim", "leaf", "first", "blocks").distinct(), query_rows)
    order = lambda *by: Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(order(*by))).where(F.col("rank") <= k)
    none = F.array().cast("array<long>")

    def same(block: Block, told: dict, query: np.ndarray, angles: np.ndarray) -> list[tuple[int, int, int]]:
        return best_same(block, told["vec_id"], told["label"], query, angles, float(min(told["bars"], default=-np.inf)), k)

    anchors = dealt.where(F.col("vec_id") % anchor_every == 0).select("row", "dim", "vec_id", "label", "v", "angles")
    near = search.visit(anchors.select("*", none.alias("tops"), none.alias("bars")), True, same)
    bars = first(near, "row").groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.array(F.min("score"))).alias("bars"))
    far = search.visit(anchors.join(bars, "row", "left").select(*anchors.columns, none.alias("tops"), F.coalesce("bars", none).alias("bars")), False, same)
    positives = materialise(first(near.unionByName(far), "row").select("row", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("top")), "positives")

    def other(block: Block, told: dict, query: np.ndarray, angles: np.ndarray) -> list[tuple[int, int, int]]:
        return best_other(block, told["label"], query, angles, told["tops"], told["bars"], share, k)

    # a window is empty at once where its top is negative; bars are never below its lower end
    lower = F.ceil(F.col("top").cast("decimal(20,0)") * share / 100).cast("long")
    windows = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("window", "top", lower.alias("bar")))).alias("w"))
    asked = anchors.join(windows, "row").select(*anchors.columns, F.col("w.top").alias("tops"), F.col("w.bar").alias("bars"))
    near = search.visit(asked, True, other)
    raised = first(near, "row", "window").groupBy("row", "window").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
    raised = raised.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "bar"))).alias("raised"))
    asked = asked.join(raised, "row", "left").withColumn("bars", F.transform("bars", lambda b, i: F.greatest(b, F.col("raised")[i])))
    far = search.visit(asked.select(*anchors.columns, "tops", "bars"), False, other)
    found = first(near.unionByName(far), "row", "window").withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    out = found.join(positives, ["row", "window"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("top").alias("positive_score"), "negative_score")


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs of an anchor and a row.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
  WHERE 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
