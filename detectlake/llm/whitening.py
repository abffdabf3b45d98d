"""PCA whitening by Chebyshev-filtered subspace iteration over distributed passes.

The covariance is never formed. A pass gives X'XQ / n for a thin matrix Q: every task multiplies its blocks of
centred rows, and Spark adds the products. A few Lanczos steps find the low end of the spectrum; then each
round filters a block of vectors by a Chebyshev polynomial that stays small over the unwanted part, makes it
orthogonal (QR) and rotates it to Ritz vectors (Rayleigh-Ritz). Rounds end when the residuals are at the
level of rounding and a search outside of the block finds no larger eigenvalue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Lanczos steps that bound the spectrum and that look for what a block missed, degree of the filter and rounds at most.
STEPS, DEGREE, ROUNDS = 12, 10, 60
#: Residuals, by the largest eigenvalue, at which a block is taken; at which one that no longer improves is; and beyond which it never is.
FINE, STUCK = 1e-14, 1e-11
#: By how much a filter may raise the largest wanted direction over the smallest: more is lost in rounding.
APART = 1e6
#: Components whose eigenvalue is below this share of the largest count as absent: their direction has no spread.
ABSENT = 1e-10
#: Bytes in a block of centred rows.
BLOCK = 1 << 20
LONG = 2**63

Apply = Callable[[np.ndarray], np.ndarray]


def by_length(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of one vector length at a time, and their whole numbers as a matrix."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            mine = batch.filter(pa.array(dims == dim))
            for at in range(0, len(mine), most):
                own = mine.slice(at, most)
                yield dim, own, own.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in longs where they hold it, else as Python's integers."""
    largest = max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // max(n, 1) + 1)
    kind = np.int64 if 4 * n * largest < LONG else object
    return n * x.astype(kind) - np.array(sums, kind)


def deviations(y: np.ndarray) -> np.ndarray:
    """The exact sum of squares of each row; fails if one doesn't fit a long."""
    if y.dtype != object and y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < LONG:
        return (y * y).sum(1)
    return np.array([sum(int(v) ** 2 for v in row) for row in y], np.int64)


def added(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of a matrix that each makes of its rows; tasks without rows give None."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = part(batches)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(own.size, dtype=np.int32)), pa.array(own.ravel())], ["at", "value"])

    found = rows.mapInArrow(work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(int(np.prod(shape)))
    out[found["at"].to_numpy()] = found["value"].to_numpy()
    return out.reshape(shape)


def covariance_pass(blocks: DataFrame, dim: int, n: int) -> Apply:
    """Q to X'XQ / n, one pass over the blocks."""

    def apply(q: np.ndarray) -> np.ndarray:
        def multiply(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for batch in batches:
                for data in batch.column(0):
                    y = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, dim)
                    product = y.T @ (y @ q)
                    total = product if total is None else total + product
            return total

        return added(blocks, multiply, q.shape) / n

    return apply


def lanczos(apply: Apply, start: np.ndarray, outside: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ritz values (rising) and vectors from a Krylov space in the complement of ``outside``, and the norm of what is left over."""

    def clear(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - outside @ (outside.T @ v) - basis @ (basis.T @ v)
        return v

    basis = np.zeros((len(start), 0))
    v, images, left = clear(start, basis), [], 0.0
    for _ in range(min(steps, len(start) - outside.shape[1])):
        size = np.linalg.norm(v)
        if not size > 1e-12 * max([1.0, *(np.linalg.norm(x) for x in images)]):
            break
        basis = np.column_stack([basis, clear(v / size, basis)])
        basis[:, -1] /= np.linalg.norm(basis[:, -1])
        images.append(apply(basis[:, -1:])[:, 0])
        v = clear(images[-1], basis)
        left = float(np.linalg.norm(v))
    if not images:
        return np.zeros(0), basis, 0.0
    small = basis.T @ np.column_stack(images)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values, basis @ turn, left


def filtered(apply: Apply, q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of the covariance over [low, high], of a degree, times Q: a pass a degree."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - middle)
    before, now = q, (apply(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        ahead = 1 / (2 / first - sigma)
        before, now = now, 2 * (apply(now) - middle * now) * (ahead / half) - sigma * ahead * before
        sigma = ahead
    return now


def leading(apply: Apply, dim: int, wanted: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and unit eigenvectors of what ``apply`` multiplies by.

    Fails if the residuals don't come down to rounding, which no covariance has been seen to do.
    """
    random = np.random.default_rng(seed)
    width = min(dim, wanted + max(8, wanted // 2))
    q = np.linalg.qr(random.standard_normal((dim, width)))[0]
    values, _, left = lanczos(apply, random.standard_normal(dim), np.zeros((dim, 0)), STEPS) if width < dim else (np.zeros(1), None, 0.0)
    low, before = max(0.0, float(values.min(initial=0.0 if not len(values) else np.inf)) - left), np.inf
    for _ in range(ROUNDS):
        image = apply(q)
        small = q.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = float(ritz[0])
        if not top > 0:
            return ritz[:wanted], q[:, :wanted]
        # what has no spread is no component, so that it needn't settle
        there = ritz[:wanted] > ABSENT * top
        off = np.linalg.norm(image - q * ritz, axis=0)[:wanted][there].max() / top
        if width == dim or off <= FINE or (off <= STUCK and off > before / 2):
            if width == dim:
                return ritz[:wanted], q[:, :wanted]
            beyond, found, _ = lanczos(apply, random.standard_normal(dim), q[:, :wanted], STEPS)
            if not len(beyond) or beyond[-1] <= ritz[wanted - 1] + 1e-10 * top:
                return ritz[:wanted], q[:, :wanted]
            q, before = np.linalg.qr(np.column_stack([q[:, :-1], found[:, -1]]))[0], np.inf
            continue
        before = off
        high = max(float(ritz[-1]), low + 1e-12 * top)
        last = float(ritz[:wanted][there][-1])
        grow = [np.arccosh(max(1.0, (2 * e - low - high) / (high - low))) for e in (top, last)]
        degree = int(np.clip(np.log(APART) / max(grow[0] - grow[1], 1e-9), 1, DEGREE))
        q = np.linalg.qr(filtered(apply, q, low, high, top, degree))[0]
    raise RuntimeError(f"subspace iteration didn't settle: residual {off:.1e}")


@dataclass(frozen=True)
class Fit:
    """What whitens the vectors of one length."""

    n: int
    sums: list[int]
    #: Components over the roots of their eigenvalues, a column each.
    turn: np.ndarray
    explained: np.ndarray
    identity_error: float

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return (y / self.n).astype(np.float64) @ self.turn


def fitted(rows: DataFrame, dim: int, n: int, sums: list[int], components: int) -> Fit:
    """Fit the rows (dim, x) of one length."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x in by_length(batches, max(1, BLOCK // (8 * dim))):
            y = (centred(x, n, sums) / n).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()), pa.array([float((y * y).sum())])], ["data", "square"])

    written = materialise(rows.where(F.col("dim") == dim).mapInArrow(block, "data binary, square double"), "centred")
    blocks = written.select("data")
    trace = written.agg(F.sum("square")).first()[0] / n
    values, vectors = leading(covariance_pass(blocks, dim, n), dim, min(components, dim))
    there = values > ABSENT * max(float(values[0]), 0.0)
    values, vectors = values[there], vectors[:, there]
    k = len(values)
    if not k:
        return Fit(n, sums, vectors, values, 0.0)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    turn = vectors / np.sqrt(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for data in batch.column(0):
                w = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, dim) @ turn
                own = np.vstack([w.T @ w, w.sum(0)])
                total = own if total is None else total + own
        return total

    sums_of = added(blocks, moments, (k + 1, k)) / n
    error = float(np.abs(sums_of[:k] - np.outer(sums_of[k], sums_of[k]) - np.eye(k)).max())
    return Fit(n, sums, turn, values / trace, error)


def whitened(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each vector and each of its leading components.

    Reads two columns. Entries become floor(scale * c) + shift, c as double. Vectors that are null or hold a
    null or a non-finite entry take no part, nor do empty ones; an id may be null, and repeated rows count each for
    itself. Returns vec_id, component (from 1, by falling eigenvalue), n, deviation (the exact sum of (n x - S)^2),
    whitened, explained and identity_error. Vectors of another length have a fit of their own. A component
    without spread (eigenvalue below 1e-10 of the largest) isn't given: a single vector, or equal ones, have
    none, and an empty table gives no rows. Where eigenvalues are equal, any basis of their space may come.
    Fails if entries, or a deviation, don't fit a long.
    """
    c = F.transform(embedding, lambda v: v.cast("double") * scale)
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    entry = lambda v: F.when(F.abs(v) < 2.0**62, F.floor(v) + shift).otherwise(F.raise_error(F.lit("an entry doesn't fit a long")).cast("long"))
    rows = vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).where(fine)
    rows = materialise(rows.select(F.col(vec_id).alias("vec_id"), F.size(embedding).alias("dim"), F.transform(c, entry).alias("x")), "whole")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for dim, _, x in by_length(batches):
            if int(np.abs(x).max(initial=0)) < 2**40:
                own = x.sum(0).tolist()
            else:
                own = [sum(map(int, col)) for col in x.T]
            n, sums = total.get(dim, (0, [0] * dim))
            total[dim] = [n + len(x), [a + b for a, b in zip(sums, own, strict=True)]]
        for dim, (n, sums) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(sums, pa.int64())], ["dim", "at", "n", "s"])

    totals = rows.select("dim", "x").mapInArrow(partial, "dim int, at int, n long, s long").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    lengths: dict[int, tuple[int, dict]] = {}
    for r in totals.collect():  # as many rows as the lengths that occur add up to
        lengths.setdefault(r.dim, (r.n, {}))[1][r.at] = r.s
    narrow = rows.select("dim", "x")
    fits = {dim: fitted(narrow, dim, n, [sums[i] for i in range(dim)], components) for dim, (n, sums) in sorted(lengths.items())}

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, x in by_length(batches, 1024):
            fit = fits[dim]
            m, k = len(x), fit.turn.shape[1]
            if not k:
                continue
            y = centred(x, fit.n, fit.sums)
            ids = own.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, fit.n), np.repeat(deviations(y), k), fit.whiten(y).ravel(), np.tile(fit.explained, m), np.full(m * k, fit.identity_error)]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(turn, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
