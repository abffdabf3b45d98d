"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Documents longer than a sequence are cut into full sequences behind a shorter first piece. Shorter pieces
are dealt evenly to groups, and each group places its pieces, longest first, where the sum over gaps of the
squared number of open bins with that gap becomes smallest (Csirik et al., 2006).
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table


class Tokens:
    """Ids of a text by the byte-level BPE vocabulary whose ranks lie beside ``path``."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})

    def ids(self, text: str) -> np.ndarray:
        return self.whole.encode_to_numpy(text, allowed_special="all").astype("<u4")


def cut_pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens: full pieces behind a first one that may be shorter."""
    head = n % most or most
    return [(0, head), *((k, most) for k in range(head, n, most))]


#: Columns of a piece, and the one for its token ids where they are asked for.
PIECE = (("doc_id", "long", pa.int64()), ("piece", "int", pa.int32()), ("start", "long", pa.int64()), ("length", "long", pa.int64()), ("ids_crc32", "long", pa.int64()))
IDS = ("ids", "array<int>", pa.list_(pa.int32()))


def tokenised(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int, most: int, columns: tuple) -> Iterator[pa.RecordBatch]:
    tokens = Tokens(vocabulary)
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(tokens.ids(text.as_py() or ""), np.uint32(end)).astype("<u4")
            for k, (start, length) in enumerate(cut_pieces(len(ids), most)):
                own = ids[start : start + length]
                rows.append((doc, k, start, length, zlib.crc32(own.data), *([own.astype(np.int32)] if IDS in columns else [])))
        made = zip(*rows, strict=True) if rows else [()] * len(columns)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(made, columns, strict=True)], [n for n, _, _ in columns])


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the order given, by the sum-of-squares rule.

    ``open_bins[g]`` is the number of open bins with gap g. Moving a bin from gap g to g - s changes the sum
    by ``2 * (open_bins[g - s] - open_bins[g]) + 2`` (less if it closes); opening one is the same from no
    gap. Among equal changes the smallest gap wins, and an open bin wins over a new one.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        change = np.where(open_bins[s:capacity] > 0, 2 * (open_bins[: capacity - s] - open_bins[s:capacity]) + 2, 1 << 60)
        if s < capacity:
            change[0] = min(change[0], 1 - 2 * open_bins[s]) if open_bins[s] else 1 << 60
        best = int(change.argmin()) if len(change) else -1
        anew = 1 + 2 * open_bins[capacity - s] if s < capacity else 0
        if best < 0 or change[best] > anew:
            gap, into, made = capacity, made, made + 1
        else:
            gap = best + s
            into = stacks[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = into, capacity - gap
        if gap > s:
            stacks[gap - s].append(into)
            open_bins[gap - s] += 1
    return bins, offsets


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2, doc_id: str = "doc_id", text: str = "text", group_rows: int = 50_000, with_ids: bool = False) -> DataFrame:
    """Place every token of every document in sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for. Null text
    counts as empty: one piece that holds only the end token. Equal rows are packed each for itself. A group
    holds about ``group_rows`` short pieces, dealt evenly by a stored row number, so that memory doesn't grow
    with the input; each group leaves a few sequences part-filled. Very long texts are cut into as many
    pieces as it takes. An empty table gives no rows.
    """
    columns = (*PIECE, IDS) if with_ids else PIECE
    schema = ", ".join(f"{n} {t}" for n, t, _ in columns)
    made = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lambda b: tokenised(b, vocabulary, end, capacity, columns), schema)
    pieces = materialise(made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, math.ceil(short.count() / group_rows))
    names = [n for n, _, _ in columns]
    full = pieces.where(F.col("length") == capacity).select(*names, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def place(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("row", "ascending")])
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        ids = bins + (key[0].as_py() << 32)
        return group.select(["row"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)) if with_ids else group.select(names).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    # the row number's low bits run on within a task and its high bits number the tasks
    dealt = short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    if not with_ids:
        return full.unionByName(dealt.groupBy("group").applyInArrow(place, schema + ", sequence_id long, offset long"))
    # ids stay where they are; only lengths go to groups, and places come back by row number
    placed = dealt.select("group", "row", "length").groupBy("group").applyInArrow(place, "row long, sequence_id long, offset long")
    return full.unionByName(short.join(placed, "row").select(*names, "sequence_id", "offset"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
