"""Containers of any size read by many tasks (S2): a segmented scan.

Where a record of a container begins depends on all records before it, so that a walk is serial. Here byte
ranges are walked side by side. Each range first guesses where its chain of records leaves it, by a vote of
walks from many of its bytes; in order, each range's exit then is the next one's entry. Entries whose exit
isn't known yet are walked, and exits that turn out otherwise are put right in further rounds until all agree
with the first byte of the file. At last every range gives the records that begin in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..scratch import materialise

#: Files are split at this byte, which stays part of the data.
BREAK = b"\n"
#: What Spark's reader takes off the beginning of a file.
MARK = b"\xef\xbb\xbf"
#: Bytes from which a range walks to guess its exit, and how many steps all of them are walked together.
STARTS, STEPS = 4_096, 64
#: Bytes of a record's head.
HEAD = 4
KEYS = ["path", "block", "number"]


def byte_ranges(spark: SparkSession, folder: str, most: int, **options: str) -> DataFrame:
    """(path, block, number, file_size, data): the bytes of files in ranges of about ``most``; a split of a file is read by one task.

    Splits end at BREAK; one without any is as long as what is between two of them. The last range of a file
    that doesn't end in BREAK has one byte too many.
    """
    # 0x0A alone, as without it the reader would break at others as well
    lines = spark.read.options(recursiveFileLookup="true", lineSep=BREAK.decode(), **options).text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("line"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, held, size = None, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            if held:
                data = BREAK.join([*held, b""])
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key[:2], number, key[2], data), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [*KEYS, "file_size", "data"])
            number, held, size = number + 1, [], 0

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True)
            at = 0
            for now, run in groupby(rows):
                n = sum(1 for _ in run)
                if now != key:
                    yield from flush()
                    key, number = now, 0
                for line in batch.column(3).slice(at, n).to_pylist():
                    held.append(line)
                    size += len(line) + 1
                    if size >= most:
                        yield from flush()
                at += n
        yield from flush()

    return lines.mapInArrow(cut, "path string, block long, number long, file_size long, data binary")


def guessed_exit(data: bytes, n: int) -> int | None:
    """Where most walks from the first bytes of a range of n bytes leave it, if any goes on for long; ``data`` may run on behind."""
    own = np.frombuffer(data, np.uint8).astype(np.int64)
    usable = min(n, len(own) - HEAD + 1)
    if usable <= 0:
        return None
    at, votes = np.arange(min(STARTS, usable)), np.ones(min(STARTS, usable), np.int64)
    for _ in range(STEPS):
        alive = at < usable
        if alive.sum() <= 1:
            break
        walked = at[alive] + HEAD + own[at[alive] + 1] + (own[at[alive] + 2] << 8) + (own[at[alive] + 3] << 16)
        at, where = np.unique(np.append(at[~alive], walked), return_inverse=True)
        votes = np.bincount(where, np.append(votes[~alive], votes[alive])).astype(np.int64)
    alive = at < usable
    if not alive.any():
        return int(at[votes.argmax()]) if votes.max() > 1 else None
    return walk(data, n, int(at[alive][votes[alive].argmax()]))[0]


def walk(data: bytes, n: int, at: int) -> tuple[int, int]:
    """From a record's beginning in a range of n bytes: the first beginning outside, and the last inside. A head cut off by the end leads nowhere."""
    last = at
    while at < n:
        last = at
        if at + HEAD > len(data):
            return 1 << 62, last
        at += HEAD + int.from_bytes(data[at + 1 : at + HEAD], "little")
    return at, last


def scan_records(spark: SparkSession, folder: str, most: int = 1 << 22, **options: str) -> DataFrame:
    """Records (path, sig_type, size, data, offset) of all containers below a folder, as ``records_of`` reads each from its first byte.

    A record is a byte of type, 24 bits of size and the data; reading ends at the first record that would
    overrun its file. Files are read in ranges of about ``most`` bytes, whatever their size, and no task holds
    more than a range and a record. Empty files give nothing. ``options`` are those of Spark's text reader.
    """
    stored = materialise(byte_ranges(spark, folder, most, **options), "ranges")
    told = stored.select(*KEYS, "file_size", F.octet_length("data").alias("n"), F.substring("data", 1, 3).alias("head"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where each range begins and which bytes follow it; ranges of a file come in order."""
        for rows in by_path(batches):
            short = rows[0]["file_size"] - sum(r["n"] for r in rows)
            marked, at = short in (2, 3), 0
            for i, r in enumerate(rows):
                mark = MARK if marked and i == 0 else b""
                r |= {"mark": mark, "start": at, "n": r["n"] + len(mark)}
                at += r["n"]
                ahead = b""
                for later in rows[i + 1 : i + 4]:
                    ahead += later["head"]
                r["ahead"] = ahead[:3]
                # what the reader has added at the end isn't there
                r["n"] = min(r["n"], r["file_size"] - r["start"])
            yield table_of(rows, PLACED)

    in_order = lambda df: df.repartition("path").sortWithinPartitions(*KEYS)  # noqa: E731  a row a range, in one task a file
    placed = materialise(in_order(told).mapInArrow(place, PLACED_SQL), "placed")
    whole = stored.select(*KEYS, "data").join(placed, KEYS)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in single_rows(batches):
            data = (r["mark"] + r["data"])[: r["n"]] + r["ahead"]
            found = guessed_exit(data, r["n"]) if r["start"] else walk(data, r["n"], 0)[0]
            yield table_of([{**{k: r[k] for k in KEYS}, "exit": None if found is None else r["start"] + found}], [*KEY_TYPES, ("exit", pa.int64())])

    guesses = materialise(whole.mapInArrow(guess, "path string, block long, number long, exit long"), "guesses")
    base = placed.select(*KEYS, "file_size", "start", "n").join(guesses, KEYS)
    walked = None

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The entry of each range, from those before it; where a walk from it isn't known, the guess stands in."""
        for rows in by_path(batches):
            at, began, sure = 0, 0, True
            for r in rows:
                end = r["start"] + r["n"]
                r |= {"entry": at if at < end else None, "began": began if at > r["start"] else None, "known": True}
                if at < end:
                    done = {k["entry"]: k for k in r["walks"] or []}.get(at)
                    r["known"] = done is not None
                    if done is not None:
                        at, began = done["exit"], done["last"]
                    else:
                        at, began = max(end, end if r["exit"] is None else r["exit"]), -1
                    # a record that overruns the file ends the reading
                    if at > r["file_size"]:
                        at = 1 << 62
                sure = sure and r["known"]
            yield table_of(rows, CHAINED)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in single_rows(batches):
            data = (r["mark"] + r["data"])[: r["n"]] + r["ahead"]
            out, last = walk(data, r["n"], r["entry"] - r["start"])
            yield table_of([{**{k: r[k] for k in KEYS}, "entry": r["entry"], "exit": min(1 << 62, r["start"] + out), "last": r["start"] + last}], [*KEY_TYPES, ("entry", pa.int64()), ("exit", pa.int64()), ("last", pa.int64())])

    while True:
        pairs = base.withColumn("walks", F.lit(None).cast(WALKS)) if walked is None else base.join(walked.groupBy(*KEYS).agg(F.collect_list(F.struct("entry", "exit", "last")).alias("walks")), KEYS, "left")
        chained = materialise(in_order(pairs).mapInArrow(chain, CHAINED_SQL), "chained")
        open_ = chained.where(~F.col("known")).select(*KEYS, "entry")
        if open_.isEmpty():
            break
        now = materialise(whole.join(open_, KEYS).mapInArrow(step, "path string, block long, number long, entry long, exit long, last long"), "walked")
        walked = now if walked is None else walked.unionByName(now)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in single_rows(batches):
            body = (r["mark"] + r["data"])[: r["n"]]
            data, n, start, size_of = body + r["ahead"], r["n"], r["start"], r["file_size"]
            rows = []
            if r["began"] is not None and r["began"] >= 0:  # the rest of a record that began before
                rows.append((r["path"], None, None, body[: (r["entry"] - start) if r["entry"] is not None else n], r["began"], start))
            at = n if r["entry"] is None else r["entry"] - start
            while at < n and at + HEAD <= len(data):
                size = int.from_bytes(data[at + 1 : at + HEAD], "little")
                if start + at + HEAD + size > size_of:
                    break
                cut = at + HEAD + size > n
                rows.append((r["path"], data[at], size, body[at + HEAD : at + HEAD + size], start + at, start if cut else None))
                at += HEAD + size
                if len(rows) >= 10_000:
                    yield parts_of(rows)
                    rows = []
            if rows:
                yield parts_of(rows)

    entries = chained.select(*KEYS, "entry", "began").where(F.col("entry").isNotNull() | F.col("began").isNotNull())
    parts = materialise(whole.join(entries, KEYS).mapInArrow(parse, "path string, sig_type int, size int, data binary, offset long, at long"), "parts")
    # a record over several ranges comes in parts, of which a range has one at each end
    cut = parts.where(F.col("at").isNotNull()).groupBy("path", "offset").agg(F.max("sig_type").alias("sig_type"), F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("at", "data"))).alias("x"))
    joined = cut.where(F.col("size").isNotNull()).select("path", "sig_type", "size", F.expr("substring(aggregate(x, X'', (whole, p) -> concat(whole, p.data)), 1, size)").alias("data"), "offset")
    return parts.where(F.col("at").isNull()).select(*schemas.RECORD.names).unionByName(joined.select(*schemas.RECORD.names))


KEY_TYPES = [("path", pa.string()), ("block", pa.int64()), ("number", pa.int64())]
PLACED = [*KEY_TYPES, ("file_size", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("start", pa.int64()), ("ahead", pa.binary())]
PLACED_SQL = "path string, block long, number long, file_size long, n long, mark binary, start long, ahead binary"
WALKS = "array<struct<entry:long,exit:long,last:long>>"
CHAINED = [*KEY_TYPES, ("entry", pa.int64()), ("began", pa.int64()), ("known", pa.bool_())]
CHAINED_SQL = "path string, block long, number long, entry long, began long, known boolean"


def table_of(rows: list[dict], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in columns], [name for name, _ in columns])


def parts_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "sig_type", "size", "data", "offset", "at"])


def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def by_path(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each file, which come together; they are small, one for each range."""
    for _, rows in groupby((r for batch in batches for r in batch.to_pylist()), lambda r: r["path"]):
        yield list(rows)
