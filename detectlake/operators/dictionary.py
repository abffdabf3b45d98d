"""Terms of a dictionary in texts (J10, C16, M7, C30): one automaton for dictionaries of all sizes.

All terms of a dictionary are looked for in one pass over a text, with overlapping hits. A dictionary of few
bytes goes to all tasks; a larger one is cut into shards by hash, and shards meet groups of texts in a
shuffle, so that no task holds more than a shard and nothing passes through the driver. Both ways give the
same hits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

#: Bytes of terms up to which a dictionary is sent to every task; of a shard of a larger one; of a group of texts that meets a shard.
SENT, SHARD, GROUP = 4 << 20, 32 << 20, 256 << 20
#: Hits in a batch that a task gives on.
BATCH = 50_000


def automaton(terms: Iterable[str]) -> ahocorasick.Automaton | None:
    """An automaton that gives a term's length at each of its ends; None without terms."""
    made = ahocorasick.Automaton()
    for term in terms:
        made.add_word(term, term)
    if not len(made):
        return None
    made.make_automaton()
    return made


def hits_of(made: ahocorasick.Automaton | None, text: str | None, every: bool) -> Iterator[tuple[str, int, int]]:
    """(term, offset, number): each hit with number 1, or each term with its first offset and how often it occurs; offsets in characters, from 0."""
    if made is None or not text:
        return
    if every:
        for end, term in made.iter(text):
            yield term, end - len(term) + 1, 1
        return
    found: dict[str, list[int]] = {}
    for end, term in made.iter(text):
        known = found.setdefault(term, [end - len(term) + 1, 0])
        known[1] += 1
    for term, (offset, n) in found.items():
        yield term, offset, n


def listed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "term", "offset", "n"])


def in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield listed(held)
            held = []
    if held:
        yield listed(held)


def term_hits(texts: DataFrame, key: str, text: str, terms: DataFrame, every: bool = False, sent: int = SENT, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """(key, term, offset, n): the terms that each text holds, exactly as they are written.

    ``texts`` has a whole number as key; a key that several rows share gets the hits of each. ``terms`` has a
    column term; null and empty ones are left out, repeated ones count once. With ``every``, each occurrence
    is a row, overlapping ones too; else each term has one, with its first offset and how often it occurs.
    Null and empty texts, and an empty dictionary, give no rows. Dictionaries of up to ``sent`` bytes go to
    all tasks; larger ones are dealt to shards of about ``shard`` bytes, which meet groups of texts of about
    ``group`` bytes: one text is sent once for each shard.
    """
    words = terms.select(F.col("term").cast("string").alias("term")).where(F.length("term") > 0).distinct()
    words = materialise(words, "terms")
    size = words.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    rows = texts.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text")).where(F.length("text") > 0)
    schema = "row long, term string, offset long, n long"
    if size <= sent:
        known = sorted(r.term for r in words.collect())

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = automaton(known)
            yield from in_batches((k, *h) for batch in batches for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for h in hits_of(made, t.as_py(), every))

        return rows.mapInArrow(find, schema).withColumnRenamed("row", key)
    shards = -(-size // shard)
    stored = materialise(rows, "texts")
    groups = max(1, -(-(stored.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group))
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = words.select(F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), every_of(groups).alias("part"), F.lit(None).cast("long").alias("row"), F.col("term").alias("text"))
    right = stored.select(every_of(shards).alias("shard"), F.pmod(F.xxhash64("row", "text"), F.lit(groups)).cast("int").alias("part"), F.coalesce("row", F.lit(0)).alias("row"), "text", F.col("row").isNull().alias("unnamed"))
    both = left.withColumn("unnamed", F.lit(None).cast("boolean")).unionByName(right)
    # terms of a shard and group come first in a task, then the texts
    dealt = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("row").isNotNull())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            at, held, made = None, [], None
            for batch in batches:
                for s, p, row, value, unnamed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if (s, p) != at:
                        at, held, made = (s, p), [], None
                    if row is None:
                        held.append(value)
                        continue
                    if held:
                        made, held = automaton(held), []
                    for h in hits_of(made, value, every):
                        yield (None if unnamed else row, *h)

        yield from in_batches(found())

    return dealt.select("shard", "part", "row", "text", "unnamed").mapInArrow(meet, schema).withColumnRenamed("row", key)


def first_class(df: DataFrame, text: str, dictionary: DataFrame, into: str, fallback: str, **sizes: int) -> DataFrame:
    """Adds the class of the first entry, by priority and term, of a dictionary (term, priority, class) that a text holds, in any case.

    Equal texts are looked through once. Terms are found wherever they stand, whatever the dictionary's size.
    """
    low = F.lower(F.col(text))
    entries = dictionary.select("priority", F.lower("term").alias("term"), "class").where(F.length("term") > 0)
    own = materialise(df.select(F.md5(low).alias("digest"), low.alias("__low")).where(F.length("__low") > 0).dropDuplicates(["digest"]).withColumn("row", F.monotonically_increasing_id()), "texts")
    found = term_hits(own, "row", "__low", entries, **sizes).select("row", "term").join(entries, "term")
    best = found.groupBy("row").agg(F.min(F.struct("priority", "term", "class"))["class"].alias("__class"))
    named = own.select("row", F.col("digest").alias("__digest")).join(best, "row").drop("row")
    return df.withColumn("__of", F.md5(low)).join(named, F.col("__of") == F.col("__digest"), "left").withColumn(into, F.coalesce("__class", F.lit(fallback))).drop("__of", "__digest", "__class")
