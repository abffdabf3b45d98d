"""A persisted inverted index for text search (F2, F8, F9, F10): posting lists of trigrams or tokens in blocks.

Rows are added in segments, each a folder that appears at once. A search reads the posting lists of its own
terms only, intersects them from the rarest on, and looks at the texts of what is left, so that it finds
exactly what a scan would find.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import children, materialise
from .filters import icontains

#: Terms that are intersected at most; the texts decide about the others.
INTERSECTED = 8


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(...))"), 1))


def tokens(text: Column) -> Column:
    """The distinct words of a text in lower case: runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


#: Postings that a task puts together before they are shuffled.
GATHERED = 1 << 20


def trigram_lists(texts: DataFrame) -> DataFrame:
    """(term, block, keys): the posting lists of ``trigrams`` over texts (key, block, text), in one piece for each run of GATHERED postings.

    Code points are read from the lower-cased texts, three of 21 bits to a number, so that a posting is three
    numbers until its list is made.
    """

    def gather(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(x) for _, _, x in held]
        key, block = (np.repeat(np.array([h[i] for h in held], np.int64), sizes) for i in (0, 1))
        code = np.concatenate([x for _, _, x in held])
        order = np.lexsort((key, block, code))
        code, block, key = code[order], block[order], key[order]
        first = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(block) != 0)))
        terms = ["".join(chr(c >> at & 0x1FFFFF) for at in (0, 21, 42)) for c in code[first].tolist()]
        keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(key))
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(block[first]), keys], ["term", "block", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for key, block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                points = np.frombuffer(text.as_buffer().to_pybytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
                if len(points) > 2:
                    held.append((key, block, np.unique(points[:-2] | points[1:-1] << 21 | points[2:] << 42)))
                    n += len(held[-1][2])
                if n >= GATHERED:
                    yield gather(held)
                    held, n = [], 0
        if held:
            yield gather(held)

    return texts.select("key", "block", F.lower("text").alias("text")).mapInArrow(run, "term string, block long, keys array<long>")


TERMS = {"trigrams": trigrams, "tokens": tokens}


@dataclass(frozen=True)
class TextIndex:
    """Texts by whole-number key under a folder. ``kind`` says what is posted: ``trigrams`` or ``tokens``.

    Posting lists lie in ``buckets`` folders by a hash of the term, in blocks of the keys of one ``span``;
    texts lie in a folder for each span.
    """

    spark: SparkSession
    folder: str
    kind: str = "trigrams"
    buckets: int = 32
    span: int = 1 << 16

    def add(self, rows: DataFrame, key: str, text: str) -> None:
        """Add rows as a segment. Keys are unique and not null; null texts are never found."""
        names = [int(n) for n in children(self.spark, self.folder) if n.isdigit()]
        draft, done = f"{self.folder}/.draft-{max(names, default=-1) + 1}", f"{self.folder}/{max(names, default=-1) + 1}"
        kept = rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).withColumn("block", F.floor(F.col("key") / self.span))
        kept.hint("rebalance", "block").write.mode("overwrite").partitionBy("block").parquet(f"{draft}/texts")
        stored = self.spark.read.schema("key long, text string, block long").parquet(f"{draft}/texts")
        if self.kind == "trigrams":
            found, keys = trigram_lists(stored), F.flatten(F.collect_list("keys"))
        else:
            found, keys = stored.select("key", "block", F.explode(TERMS[self.kind](F.col("text"))).alias("term")), F.collect_list("key")
        lists = found.groupBy("term", "block").agg(F.sort_array(keys).alias("keys")).withColumns({"n": F.size("keys"), "bucket": self._bucket(F.col("term"))})
        lists.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{draft}/lists")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(draft)
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.rename(place, self.spark._jvm.org.apache.hadoop.fs.Path(done)):
            raise OSError(f"{done} could not be written")

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _read(self, part: str, by: str, wanted: set[int] | None, schema: str) -> DataFrame:
        """Rows of all segments, from the folders ``by`` the wanted numbers only."""
        found = None
        for n in sorted((n for n in children(self.spark, self.folder) if n.isdigit()), key=int):
            base = f"{self.folder}/{n}/{part}"
            there = [x for x in children(self.spark, base) if x.startswith(f"{by}=") and (wanted is None or int(x.split("=")[1]) in wanted)]
            if there:
                rows = self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{x}" for x in there))
                found = rows if found is None else found.unionByName(rows)
        return self.spark.createDataFrame([], schema) if found is None else found

    def lists(self, terms: list[str]) -> DataFrame:
        """The posting lists (term, block, keys, n) of some terms; no other bucket's files are read."""
        wanted = {r.b for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term")).alias("b")).collect()} if terms else set()
        return self._read("lists", "bucket", wanted, "term string, block long, keys array<long>, n int, bucket int").where(F.col("term").isin(terms))

    def texts(self, blocks: set[int] | None = None) -> DataFrame:
        return self._read("texts", "block", blocks, "key long, text string, block long").select("key", "text", "block")

    def candidates(self, terms: list[str]) -> DataFrame:
        """(key, block) of the rows that hold the rarest of some terms, INTERSECTED of them at most."""
        lists = materialise(self.lists(terms).select("term", "block", "keys", "n"), "lists")
        counts = {r.term: r.n for r in lists.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if len(counts) < len(set(terms)):  # a term that no text has
            return self.spark.createDataFrame([], "key long, block long")
        rarest = sorted(counts, key=lambda t: (counts[t], t))[:INTERSECTED]
        of = lambda t: lists.where(F.col("term") == t).select("block", F.explode("keys").alias("key"))
        found = of(rarest[0])
        for term in rarest[1:]:
            found = found.join(of(term), ["block", "key"], "left_semi")
        return found.select("key", "block")

    def _verified(self, terms: list[str], holds: Column) -> DataFrame:
        near = materialise(self.candidates(terms), "candidates")
        blocks = {r.block for r in near.select("block").distinct().collect()}  # one for each span of keys
        return self.texts(blocks).join(near, ["block", "key"], "left_semi").where(holds).select("key", "text")

    def containing(self, query: str) -> DataFrame:
        """(key, text) of the rows whose text contains a string, in any case, as ``icontains`` finds them.

        A query of fewer than three characters, or an index of tokens, has no trigram to look up: all texts are read.
        """
        holds = icontains("text", query)
        low = self.spark.range(1).select(F.lower(F.lit(query))).first()[0]
        if self.kind != "trigrams" or len(low) < 3:
            return self.texts().where(holds).select("key", "text")
        return self._verified(list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2))), holds)

    def with_tokens(self, query: str) -> DataFrame:
        """(key, text) of the rows that hold all words of a query, in any case; a query without words gives none."""
        words = self.spark.range(1).select(tokens(F.lit(query))).first()[0]
        if not words:
            return self.spark.createDataFrame([], "key long, text string")
        own = tokens(F.col("text"))
        holds = F.size(F.array_intersect(own, F.array(*map(F.lit, words)))) == len(words)
        if self.kind != "tokens":
            return self.texts().where(holds).select("key", "text")
        return self._verified(words, holds)
