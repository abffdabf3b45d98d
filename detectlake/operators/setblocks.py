"""All pairs of sets by products of blocks, for sets whose values are so common that nearly all pairs meet."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of a block, values of a block, and cells of what a task holds at once.
SETS, VALUES, CELLS = 1 << 11, 1 << 22, 1 << 22
#: Blocks' pairs go to at most this many tasks.
MOST_TASKS = 1 << 12

#: From shared values and sizes of both sets: which pairs are given, and the number that is given with each.
Rule = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def counts_from(least: int) -> Rule:
    return lambda both, nx, ny: (both >= least, both.astype(np.int64))


def jaccard_from(least: float) -> Rule:
    """Rounded to four decimals, halves up."""

    def rule(both: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = both / (nx + ny - both)
        return (both > 0) & (score >= least), np.floor(score * 1e4 + 0.5) / 1e4

    return rule


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each span, one behind the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def packed(keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """A block by columns: values that a sixteenth of its sets have as rows of bits, others as lists of sets."""
    m = len(keys)
    values, code, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(m), sizes)[np.argsort(code, kind="stable")]
    starts, common = np.cumsum(counts) - counts, counts * 16 >= m
    bits = np.zeros((int(common.sum()), m), bool)
    bits[np.repeat(np.arange(len(bits)), counts[common]), rows[spans(starts[common], counts[common])]] = True
    listed = rows[spans(starts[~common], counts[~common])].astype(np.uint16 if m <= 1 << 16 else np.int32)
    out = io.BytesIO()
    np.savez(out, keys=keys, sizes=sizes, common=values[common], bits=np.packbits(bits, axis=1), rare=values[~common], counts=counts[~common], listed=listed)
    return out.getvalue()


class Block:
    """Sets by columns: of each value the sets that have it."""

    def __init__(self, data: bytes) -> None:
        of = np.load(io.BytesIO(data))
        self.keys, self.sizes = of["keys"], of["sizes"]
        bits = np.unpackbits(of["bits"], axis=1, count=len(self.keys))
        self.values = np.concatenate([of["common"], of["rare"]])
        self.counts = np.concatenate([bits.sum(axis=1, dtype=np.int64), of["counts"].astype(np.int64)])
        self.starts = np.cumsum(self.counts) - self.counts
        self.rows = np.concatenate([np.nonzero(bits)[1], of["listed"].astype(np.int64)])

    def columns(self, which: np.ndarray, kind: type) -> np.ndarray:
        out = np.zeros((len(self.keys), len(which)), kind)
        out[self.rows[spans(self.starts[which], self.counts[which])], np.repeat(np.arange(len(which)), self.counts[which])] = 1
        return out


def shared(x: Block, y: Block) -> np.ndarray:
    """How many values each set of x shares with each of y: common values are multiplied, rare ones counted by pairs."""
    _, ix, iy = np.intersect1d(x.values, y.values, assume_unique=True, return_indices=True)
    cx, cy, (m, n) = x.counts[ix], y.counts[iy], (len(x.keys), len(y.keys))
    # float32 is exact up to 2^24
    kind = np.float32 if min(x.sizes.max(), y.sizes.max()) < 1 << 24 else np.float64
    out = np.zeros((m, n), kind)
    dense = np.flatnonzero(cx * cy * 256 >= m * n)
    width = max(1, CELLS // max(m, n))
    for at in range(0, len(dense), width):
        some = dense[at : at + width]
        out += x.columns(ix[some], kind) @ y.columns(iy[some], kind).T
    rare = np.flatnonzero(cx * cy * 256 < m * n)
    ends, at = np.cumsum(cx[rare] * cy[rare]), 0
    while at < len(rare):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + CELLS, side="right")))
        i, j = ix[rare[at:stop]], iy[rare[at:stop]]
        # each set of x beside all of y under the same value
        a = spans(x.starts[i], x.counts[i])
        times = np.repeat(y.counts[j], x.counts[i])
        b = spans(np.repeat(y.starts[j], x.counts[i]), times)
        out += np.bincount(np.repeat(x.rows[a], times) * n + y.rows[b], minlength=m * n).reshape(m, n).astype(kind)
        at = stop
    return out


def pairs_of(x: Block, y: Block, same: bool, rule: Rule, stripe: int = 256) -> Iterator[pa.RecordBatch]:
    both, places = shared(x, y), np.arange(len(y.keys))
    nx, ny = x.sizes.astype(np.float64), y.sizes.astype(np.float64)
    for at in range(0, len(x.keys), stripe):
        kept, number = rule(both[at : at + stripe].astype(np.float64), nx[at : at + stripe, None], ny[None, :])
        if same:
            kept &= places[None, :] > np.arange(at, at + len(kept))[:, None]
        i, j = np.nonzero(kept)
        a, b = x.keys[at + i], y.keys[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(number[i, j])], ["a", "b", "x"])


def block_pairs(sets: DataFrame, rule: Rule, number: str, size: int = SETS) -> DataFrame:
    """(a, b, ``number``) of all pairs of sets (key long, vs, n) that a rule gives; ``number`` has a name and a type.

    Sets are dealt to blocks of about ``size``, packed by columns. Each pair of blocks meets in one task, which gives
    its pairs on as they are: what is shuffled are blocks, once for each other block, and never pairs.
    """
    count, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-count // size), -(-total // VALUES))

    def pack(table: pa.Table) -> pa.Table:
        vs = table.column("vs").combine_chunks()
        sizes = vs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        data = packed(table.column("key").to_numpy(), sizes, vs.flatten().to_numpy(zero_copy_only=False))
        return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([data], pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are sorted by pair: both blocks of one, or the one that meets itself
        pair, x = None, None
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(data.as_py())
                if p // blocks == p % blocks:
                    yield from pairs_of(block, block, True, rule)
                elif p == pair:
                    yield from pairs_of(x, block, False, rule)
                else:
                    pair, x = p, block

    dealt = sets.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("long").alias("block"), "key", "vs")
    made = dealt.groupBy("block").applyInArrow(pack, "block long, data binary")
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda u: F.least("block", u) * blocks + F.greatest("block", u))
    rows = made.select(F.explode(every).alias("p"), "data")
    # by number, so that few bytes don't make few tasks
    tasks = min(blocks * (blocks + 1) // 2, MOST_TASKS)
    name, kind = number.split()
    met = rows.repartition(tasks, "p").sortWithinPartitions("p").mapInArrow(meet, f"a long, b long, x {kind}")
    return met.withColumnRenamed("x", name)
