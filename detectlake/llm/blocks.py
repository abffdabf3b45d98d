"""A stated set of query vectors against all vectors, through blocks that lie together in a projection.

A kd-tree over Gaussian projections deals every row to a leaf, and a leaf's rows to blocks of bounded size.
Each query first goes to its nearest leaf. The k-th best score from there tells, by what is known of each
leaf, which other leaves can still matter, and the query goes to those alone. A block's rows are sent once a
round and indexed once; queries stream past the index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Projected dimensions (an even number) and the seed of the projection.
DIMENSIONS, SEED = 10, 20
#: Rows, by the order of a hash, from which the tree is made, and its leaves at most. Every row is indexed by it.
SAMPLE_ROWS, LEAVES = 65_536, 4_096


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """An array column of equal lengths without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def norms(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows, also of those whose squares are beyond a double."""
    most = np.abs(rows).max(1, initial=0.0)
    scaled = rows / np.where(most > 0, most, 1.0)[:, None]
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt((scaled**2).sum(1)), np.finfo(float).max)


def projected(rows: np.ndarray, most: float, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows as points of a unit sphere on which nearness is the inner product, and their projections.

    A row gets one more component, sqrt(M^2 - |x|^2), with M the largest norm; a query is scaled to the norm
    M and gets a zero. The squared distance of the points is 2 minus twice the product by M and the query's norm.
    """
    norm = norms(rows)
    if query:
        unit = np.column_stack([rows / np.where(norm > 0, norm, 1.0)[:, None], np.zeros(len(rows))])
    else:
        unit = np.column_stack([rows / most, np.sqrt(np.maximum(0, 1 - (norm / most) ** 2))])
    return unit, unit @ np.random.default_rng(SEED).standard_normal((unit.shape[1], DIMENSIONS))


@dataclass(frozen=True)
class Tree:
    """Splits of a complete kd-tree, in heap order, and the largest norm of the rows."""

    most: float
    axis: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.empty(0))

    @staticmethod
    def over(points: np.ndarray, most: float, leaves: int) -> Tree:
        axis, cut, level = [], [], [points]
        while 2 * len(level) <= leaves and len(points) >= 4 * len(level):
            parts = []
            for own in level:
                spread = own.max(0) - own.min(0) if len(own) else np.zeros(DIMENSIONS)
                axis.append(int(spread.argmax()))
                cut.append(float(np.median(own[:, axis[-1]])) if len(own) else 0.0)
                right = own[:, axis[-1]] > cut[-1]
                parts += [own[~right], own[right]]
            level = parts
        return Tree(most, np.array(axis, np.int64), np.array(cut))

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        while len(self.axis) and at.min(initial=len(self.axis)) < len(self.axis):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.axis[at]] > self.cut[at])
        return at - len(self.axis)


class Index(Protocol):
    """What a block's rows become, once a block and round."""

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query position, vec_id and score of the k best rows for each query that may reach its bar."""


@dataclass(frozen=True)
class Method:
    """How a search bounds leaves and looks into blocks."""

    #: Points whose box is kept for each leaf, from rows and the largest norm.
    points: Callable[[np.ndarray, float], np.ndarray]
    #: The best score that a leaf may hold, by query and leaf, from queries, largest norm, and the boxes' lower and upper ends.
    reach: Callable[[np.ndarray, float, np.ndarray, np.ndarray], np.ndarray]
    index: Callable[[np.ndarray, np.ndarray, float], Index]
    #: Arrow and SQL type of scores.
    score: tuple[pa.DataType, str]


def trees(stored: DataFrame, block_rows: int) -> dict[int, Tree]:
    """A tree for each length of vectors; few lengths occur."""

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([norms(np.array([v.values.to_numpy()]))[0] for v in batch.column(1)], pa.float64())], ["dim", "norm"])

    totals = stored.select("dim", "v").mapInArrow(longest, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("most"), F.count(F.lit(1)).alias("n")).collect()
    most = {r.dim: r.most or 1.0 for r in totals}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, v in by_dim(batches, "v"):
            yield pa.RecordBatch.from_arrays([own.column("dim"), own.column("row"), pa.array(list(projected(v, most[dim])[1]), pa.list_(pa.float64()))], ["dim", "row", "low"])

    low = stored.select("dim", "row", "v").mapInArrow(project, "dim int, row long, low array<double>")
    sample: dict[int, list] = {}
    for r in low.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).toLocalIterator():
        sample.setdefault(r.dim, []).append(r.low)
    return {r.dim: Tree.over(np.array(sample.get(r.dim, []), np.float64).reshape(-1, DIMENSIONS), most[r.dim], min(LEAVES, -(-r.n // block_rows))) for r in totals}


def by_dim(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each vector length in each batch, and their vectors."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            yield dim, own, matrix(own.column(column))


def search_blocks(vectors: DataFrame, is_query: object, k: int, method: Method, block_rows: int, query_rows: int) -> DataFrame:
    """The k best of all other rows for each query row, as far as the method finds them.

    ``vectors``: vec_id long, v array without nulls or components that aren't finite; only vectors of equal
    length, 1 at least, meet. A row with the query's own vec_id isn't a candidate. Ties go to smaller ids.
    A block holds about ``block_rows`` rows; a block that more than ``query_rows`` queries ask for is sent
    once for each so many of them. Returns query_id, rank, vec_id and score.
    """
    score, sql = method.score
    rows = vectors.select(F.col("vec_id").cast("long"), "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"))
    stored = materialise(rows.where("dim > 0").withColumn("asks", is_query), "vectors")
    forest = trees(stored, block_rows)
    if not forest:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {sql}")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, v in by_dim(batches, "v"):
            tree = forest[dim]
            yield own.append_column("leaf", pa.array(tree.leaf(projected(v, tree.most)[1]), pa.int64()))

    dealt = materialise(stored.mapInArrow(deal, "vec_id long, v array<double>, dim int, row long, asks boolean, leaf long"), "dealt")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for dim, own, v in by_dim(batches, "v"):
            points, leaves = method.points(v, forest[dim].most), own.column("leaf").to_numpy()
            for leaf in np.unique(leaves).tolist():
                mine = points[leaves == leaf]
                n, low, high = found.get((dim, leaf), (0, np.inf, -np.inf))
                found[dim, leaf] = [n + len(mine), np.minimum(low, mine.min(0)), np.maximum(high, mine.max(0))]
        for (dim, leaf), (n, low, high) in found.items():
            at = np.arange(len(low))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(low), dim, np.int32), np.full(len(low), leaf), at.astype(np.int32), np.where(at == 0, n, 0), low, high)], ["dim", "leaf", "at", "n", "low", "high"])

    # one row for each leaf and dimension, LEAVES leaves at most for each length
    told = dealt.select("dim", "leaf", "v").mapInArrow(ends, "dim int, leaf long, at int, n long, low double, high double")
    told = told.groupBy("dim", "leaf", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values(["dim", "leaf", "at"])
    boxes, leaf_rows, first = {}, [], 0
    for dim, own in told.groupby("dim"):
        leaves = own["leaf"].unique()
        low, high = (own[c].to_numpy().reshape(len(leaves), -1) for c in ("low", "high"))
        counts = own["n"].to_numpy().reshape(len(leaves), -1)[:, 0]
        boxes[int(dim)] = (leaves, low, high)
        for leaf, n in zip(leaves.tolist(), counts.tolist(), strict=True):
            blocks = -(-n // block_rows)
            leaf_rows.append((int(dim), leaf, first, blocks))
            first += blocks
    spark = vectors.sparkSession
    of_leaf = spark.createDataFrame(leaf_rows, "dim int, leaf long, first long, blocks long")
    placed = dealt.join(F.broadcast(of_leaf), ["dim", "leaf"])
    placed = placed.select((F.col("first") + F.pmod(F.xxhash64("row"), "blocks")).alias("block"), "row", "vec_id", "v")

    def route(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
        """The leaves that queries (row, dim, v, bar) go to: the nearest one, or all others that can matter."""
        for dim, own, v in by_dim(batches, "v"):
            leaves, low, high = boxes[dim]
            bars = own.column("bar").to_numpy(zero_copy_only=False)
            for at in range(0, len(v), 32):
                some = method.reach(v[at : at + 32], forest[dim].most, low, high)
                best = some.argmax(1)
                if nearest:
                    q, leaf = np.arange(len(some)), best
                else:
                    some[np.arange(len(some)), best] = -np.inf
                    q, leaf = np.nonzero((some >= np.nan_to_num(bars[at : at + 32], nan=-np.inf)[:, None]) & (some > -np.inf))
                yield pa.RecordBatch.from_arrays([own.column("row").take(pa.array(q + at)), pa.array(np.full(len(q), dim, np.int32)), pa.array(leaves[leaf], pa.int64())], ["row", "dim", "leaf"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams a task's blocks: the rows of each come first, then the queries that ask for it."""
        key, held, index, dim = None, [], None, 0
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            edges = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0) | (np.diff(columns[2]) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                if a == b:
                    continue
                if (columns[0][a], columns[1][a]) != key:
                    key, held, index = (columns[0][a], columns[1][a]), [], None
                ids, v = columns[4][a:b], matrix(batch.column("v").slice(a, b - a))
                if not columns[2][a]:
                    held.append((ids, v))
                    dim = v.shape[1]
                    continue
                if index is None and held:
                    index = method.index(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), forest[dim].most)
                    held = []
                if index is not None:
                    bars = np.nan_to_num(batch.column("bar").to_numpy(zero_copy_only=False)[a:b], nan=-np.inf)
                    q, found, value = index.search(ids, v, bars, k)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[3][a:b][q]), pa.array(ids[q]), pa.array(found), pa.array(value, score)], ["row", "query_id", "vec_id", "score"])

    queries = dealt.where("asks").select("row", "dim", "vec_id", "v")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def visit(asked: DataFrame, nearest: bool) -> DataFrame:
        """The k best for each of the queries (row, dim, vec_id, v, bar) in the leaves that it goes to."""
        ways = asked.select("row", "dim", "v", "bar").mapInArrow(lambda b: route(b, nearest), "row long, dim int, leaf long")
        ways = ways.join(F.broadcast(of_leaf), ["dim", "leaf"]).select("row", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("block"))
        ways = materialise(ways, "ways")
        parts = ways.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("parts"))
        sides = placed.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "row", "vec_id", "v", F.lit(None).cast("double").alias("bar"))
        asks = ways.join(asked, "row").join(parts, "block").select("block", F.pmod(F.xxhash64("row"), "parts").alias("part"), F.lit(1).alias("kind"), "row", "vec_id", "v", "bar")
        both = sides.unionByName(asks).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
        return materialise(top(both.mapInArrow(meet, f"row long, query_id long, vec_id long, score {sql}")).drop("rank"), "found")

    near = visit(queries.withColumn("bar", F.lit(None).cast("double")), True)
    bars = near.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("bar"))
    far = visit(queries.join(bars, "row", "left"), False)
    return top(near.unionByName(far)).select("query_id", "rank", "vec_id", "score")
