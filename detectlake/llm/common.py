"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder

#: A word, in every contract of this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    The folder is deleted when the application ends, or at the end of the ``settled`` around the call.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/detectlake-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    if _SCRATCH:
        _SCRATCH[-1].append(place)
    return spark.read.schema(df.schema).parquet(path)


#: What to delete at the end of each ``settled`` that is under way, the innermost last.
_SCRATCH: list[list] = []


def settled(df: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what ``df()`` gives, then delete all tables that were materialised for it: nothing reads them any more."""
    _SCRATCH.append([])
    try:
        made = df()
    finally:
        inner = _SCRATCH.pop()
    out = materialise(made, name)
    for place in inner:
        place.getFileSystem(out.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return out


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64 arrays (xor-shift and multiply, wrapping)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Byte to lower-case byte, and whether a byte is white space.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.empty(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), 0x9E3779B97F4A7C15, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def _hash_piece(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word in one piece of joined texts."""
    inside = ~SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[starts] = inside[starts]
    first = np.flatnonzero(opens)
    if not len(first):
        return np.empty(0, np.uint64), first
    place = np.arange(len(data))
    place[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(data))))
    place[~inside] = 0
    value = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    value[~inside] = 0
    return mix64(np.add.reduceat(value, first)), first


def word_hashes(data: np.ndarray, starts: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of joined texts, and the number of the text that each is in.

    ``data``: the lower-case bytes of all texts, one after another; ``starts``: where each text begins. A
    word never crosses texts. The bytes are worked off in pieces that end at white space or at a text's
    end, so that memory follows the longest word and not the longest text.
    """
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + piece)
        while end < len(data) and not SPACE[data[end]]:
            ahead = np.flatnonzero(SPACE[data[end : end + piece]])
            later = starts[np.searchsorted(starts, end) :]
            stop = end + (int(ahead[0]) if len(ahead) else min(piece, len(data) - end))
            end = min(stop, int(later[0])) if len(later) and later[0] >= end else stop
            if len(later) and later[0] == end:
                break
        own = starts[(starts >= at) & (starts < end)] - at
        h, f = _hash_piece(data[at:end], own)
        hashes.append(h)
        firsts.append(f + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(starts, np.concatenate(firsts), "right") - 1


def text_slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: number of the first, lower-case bytes, and where each begins.

    The starts have one more entry, the number of bytes. Null counts as empty; a longer text is a run alone.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, LOWER[data[ends[at] : ends[to]]], (ends[at : to + 1] - ends[at])
        at = to
