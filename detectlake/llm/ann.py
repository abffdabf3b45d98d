"""Approximate nearest neighbours with a low-dimensional stable projection and a kd-tree.

Gaussian projections are 2-stable: a point at distance D from the query has a projected distance r with
r^2 / D^2 chi-square distributed. Projected neighbours come in order from a kd-tree and are verified on the
original vectors; reading stops when a point that is nearer than the k-th best found would, with probability
``sure``, have had a smaller projected distance than the next unread one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import DIMENSIONS, Method, norms, projected, search_blocks
from .common import table

#: Certainty of the stopping test, and points in a leaf of a block's own tree.
SURE, LEAF = 0.9, 64


def chi_square_quantile(share: float, dims: int) -> float:
    """The x at which the chi-square distribution function with an even number of degrees reaches ``share``."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < share else (low, mid)
    return high


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Positions of the points in each leaf of a kd-tree split at the median of the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.append(part)
            continue
        own = points[part]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        half = np.argpartition(own[:, axis], len(part) // 2)
        todo += [part[half[len(part) // 2 :]], part[half[: len(part) // 2]]]
    return out


def inner_products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, so that equal rows get equal scores."""
    total = np.zeros(len(rows))
    for j in range(len(q)):
        total += rows[:, j] * q[j]
    return total


def box_gaps(points: np.ndarray, floor: np.ndarray, roof: np.ndarray) -> np.ndarray:
    """Squared distances of points (first axis) from boxes (second)."""
    return sum(np.maximum(0, np.maximum(floor[:, j] - points[:, j, None], points[:, j, None] - roof[:, j])) ** 2 for j in range(points.shape[1]))


def best_in_boxes(queries: np.ndarray, most: float, floor: np.ndarray, roof: np.ndarray) -> np.ndarray:
    """The inner products below which the stopping test holds for boxes: no point in them is likely to be better.

    A point at squared distance D of the unit sphere has a projected one of more than ``stop * D`` with
    probability 1 - SURE only, so a box that far away is passed over once the k-th best is nearer than D.
    """
    gaps = box_gaps(projected(queries, most, query=True)[1], floor, roof)
    return (1 - gaps / (2 * chi_square_quantile(SURE, DIMENSIONS))) * most * norms(queries)[:, None]


class ProjectedTree:
    """A block's rows by a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, most: float):
        self.ids, self.rows, self.most = ids, rows, most
        unit, low = projected(rows, most)
        leaves = kd_leaves(low, LEAF)
        self.member = np.full((len(leaves), max(map(len, leaves))), -1)
        for i, leaf in enumerate(leaves):
            self.member[i, : len(leaf)] = leaf
        self.floor, self.roof = np.stack([low[x].min(0) for x in leaves]), np.stack([low[x].max(0) for x in leaves])
        self.flat, self.stop = unit.astype(np.float32), chi_square_quantile(SURE, DIMENSIONS)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """About the k best rows for each query, with exact products; leaves are read in order until the stopping test holds."""
        asked, looked = projected(queries, self.most, query=True)
        scale, out = norms(queries) * self.most, []
        for j, q in enumerate(queries):
            gap = box_gaps(looked[j : j + 1], self.floor, self.roof)[0]
            order = np.argsort(gap)
            line, at, step = asked[j].astype(np.float32), 0, 8
            pool, value, bar = np.empty(0, np.int64), np.empty(0, np.float32), bars[j] / scale[j]
            while at < len(order) and (bar == -np.inf or gap[order[at]] < self.stop * max(1e-9, 2 - 2 * bar)):
                new = self.member[order[at : at + step]].ravel()
                new = new[new >= 0]
                new = new[self.ids[new] != query_ids[j]]
                product = self.flat[new] @ line
                keep = product >= bar - 1e-5
                pool, value = np.concatenate([pool, new[keep]]), np.concatenate([value, product[keep]])
                if len(value) >= k:
                    bar = max(bar, float(np.partition(value, len(value) - k)[len(value) - k]))
                at, step = at + step, step * 2 if at < 32 else step
            pool = pool[value >= bar - 1e-5]
            exact = inner_products(self.rows[pool], q)
            best = np.lexsort((self.ids[pool], -exact))[:k]
            out.append((np.full(len(best), j), self.ids[pool[best]], exact[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


METHOD = Method(points=lambda rows, most: projected(rows, most)[1], reach=best_in_boxes, index=ProjectedTree, score=(pa.float64(), "double"))


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = 16_384, query_rows: int = 65_536) -> DataFrame:
    """About the k rows with the largest inner product for each query row, with exact scores.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows with another id,
    ties to smaller ids. Rows whose id or vector is null, or whose vector is zero or holds null or
    non-finite components, take no part; only vectors of equal length meet. Every row is indexed: a tree over
    all rows, made from a bounded sample, has blocks as its leaves, and each block a tree of its own. The
    stopping test decides which blocks a query goes to and where it stops in each. Repeated rows count each
    for itself. An empty table gives no rows.
    """
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    usable = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(fine).select(F.col(vec_id).alias("vec_id"), x.alias("v"))
    return search_blocks(usable, F.col("vec_id") % query_every == 0, k, METHOD, block_rows, query_rows)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
