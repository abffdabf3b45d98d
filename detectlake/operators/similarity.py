"""Related entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise
from .setblocks import block_pairs, counts_from, jaccard_from


def store_pairs(pairs: DataFrame, kind: str, once: bool = False) -> DataFrame:
    """Ordered pairs, one for each kind, with the best score; pairs that come once each anyway aren't grouped."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    best = ordered if once else ordered.groupBy("a", "b").agg(F.max("score").alias("score"))
    return best.withColumn("kind", F.lit(kind))


def exact_duplicates(items: DataFrame) -> DataFrame:
    """(data_hash, hub, owner): every further owner of a payload beside its first one.

    A payload with very many owners gives as many rows as owners, not pairs of them: all of them are equal,
    so the star says the same.
    """
    owners = items.select("data_hash", "owner").distinct()
    hubs = owners.groupBy("data_hash").agg(F.min("owner").alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return owners.join(hubs, "data_hash").where(F.col("owner") != F.col("hub")).select("data_hash", "hub", "owner")


def family_candidates(entities: DataFrame) -> DataFrame:
    """(family, signature_id, candidates): every entity with as many others of its family, if there are any.

    The candidates of an entity are all others of its family. They are given as membership and not as pairs,
    of which a family has as many as the square of its size; ``set_similarity`` takes the family as part of
    its join key and finds the similar ones.
    """
    sizes = entities.groupBy("family").agg((F.count(F.lit(1)) - 1).alias("candidates")).where("candidates > 0")
    return entities.select("family", "signature_id").join(sizes, "family")


def in_band(x: Column, y: Column) -> Column:
    """Whether a size lies within half to twice another, in whole numbers."""
    return y.between(F.floor(x / 2), x * 2)


def size_band_counts(items: DataFrame, key: str, size: str, span: int = 1 << 16) -> DataFrame:
    """(key, partners): how many other rows' sizes lie within half to twice of each row's.

    Counts by size are summed up once; each size then looks its band's ends up in the sums. Sizes are sorted
    within spans of ``span``, and only the sums of spans are added up in one place; no pairs are made.
    """
    counts = items.groupBy(F.col(size).cast("long").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    # a band's ends are asked for just below half and at twice a size
    ask = lambda at, what, n: F.struct(at.alias("at"), F.lit(what).alias("what"), n.alias("n"))
    none, s = F.lit(0).cast("long"), F.col("s")
    asked = counts.select("s", F.explode(F.array(ask(s, "own", F.col("n")), ask(F.floor(s / 2) - 1, "below", none), ask(s * 2, "upto", none))).alias("x"))
    asked = asked.withColumn("span", F.floor(F.col("x.at") / span))
    spans = asked.groupBy("span").agg(F.sum("x.n").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("x.n").over(Window.partitionBy("span").orderBy("x.at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    asked = asked.join(spans.select("span", before.alias("before")), "span").withColumn("sum", F.col("before") + within)
    band = asked.groupBy("s").agg((F.max(F.when(F.col("x.what") == "upto", F.col("sum"))) - F.coalesce(F.max(F.when(F.col("x.what") == "below", F.col("sum"))), F.lit(0)) - 1).alias("partners"))
    return items.select(key, F.col(size).cast("long").alias("s")).join(band, "s").select(key, "partners")


def whole_sets(rows: DataFrame) -> DataFrame:
    """(key, vs, n) of rows (key, v) with repeats, which are dealt by key as they are and go no further than that."""
    whole = rows.select("key", "v").where("key is not null").repartition("key").distinct().groupBy("key").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    return whole.withColumn("n", F.size("vs"))


def set_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of keys with equal sets of hashes (key, v): members (a, b, n) beside each class's smallest key, and (key, vs, n) of those.

    All but the dealing of rows has a row a key, and lists are taken on of one key a class only.
    """
    every = materialise(whole_sets(rows).withColumns({"h1": F.xxhash64("vs"), "h2": F.xxhash64(F.lit(1), "vs")}), "sets")
    first = every.groupBy("h1", "h2").agg(F.min("key").alias("key"))
    listed = materialise(every.join(first.select("key"), "key", "left_semi").select("key", "vs", "n"), "classes")
    of = every.select(F.col("key").alias("b"), "h1", "h2", "n").join(first.withColumnRenamed("key", "a"), ["h1", "h2"])
    return of.where("a <> b").select("a", "b", "n"), listed


#: A posting that meets another is dearer than a pair in a product of blocks, by about this.
MEETING = 32


def crowded(listed: DataFrame, posted: DataFrame) -> bool:
    """Whether postings would meet so often that a product of all sets is cheaper; both ways give the same pairs."""
    n = listed.count()
    met = posted.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0]
    return isinstance(listed.schema["key"].dataType, T.LongType) and (met or 0) * MEETING > n * (n - 1) / 2


def by_rarity(sets: DataFrame) -> DataFrame:
    """Sets (key, vs, n) with their values from the rarest on; any one order of values is exact."""
    rows = sets.select("key", F.explode("vs").alias("v"))
    df = rows.groupBy("v").agg(F.count(F.lit(1)).alias("df"))
    listed = rows.join(df, "v").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    return materialise(listed.select("key", F.transform("vs", lambda x: x["v"]).alias("vs")).withColumn("n", F.size("vs")), "listed")


def shared_between_classes(values: DataFrame, least: int) -> DataFrame:
    """(a, b, n): as ``shared_between``, with rules of equal values as a class.

    Each rule is paired with the smallest one of its class, and that one alone with those of other classes:
    copies of rules give a row each, and no values are lost.
    """
    members, listed = set_classes(rule_hashes(values))
    return shared_sets(listed, least).unionByName(members.where(F.col("n") >= least).select("a", "b", F.col("n").cast("long").alias("n")))


def shared_between(values: DataFrame, least: int = 1, block: int = 512) -> DataFrame:
    """(a, b, n): how many values each pair of rules shares, for pairs that share at least ``least``.

    Where values are rare, rules meet under them: with ``least`` above 1, a rule posts its rarest values only, all
    but ``least - 1`` of them, and pairs that meet are counted over all their values. The rules of a value go to
    blocks of about ``block``, and pairs of blocks meet apart, so that a value that many rules list is shared out
    over as many tasks. Where rules would meet under very many values, they are multiplied in blocks.
    """
    return shared_sets(materialise(whole_sets(rule_hashes(values)), "sets"), least, block)


def rule_hashes(values: DataFrame) -> DataFrame:
    """(key, v): values (guid, field, value) as hashes; a missing value is equal to none."""
    return values.where("field is not null and value is not null").select(F.col("guid").alias("key"), F.xxhash64("field", "value").alias("v"))


def shared_sets(sets: DataFrame, least: int, block: int = 512) -> DataFrame:
    """``shared_between`` for sets (key, vs, n) of hashed values."""
    listed = sets if least == 1 else by_rarity(sets)
    posted = listed.select("key", "n", F.posexplode(F.slice("vs", 1, F.greatest(F.col("n") - (least - 1), F.lit(0)))).alias("at", "v"))
    if crowded(listed, posted):
        return block_pairs(listed, counts_from(least), "n long")
    sizes = posted.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("v", F.ceil(F.col("df") / block).alias("blocks"))
    dealt = posted.join(sizes, "v").withColumn("own", F.pmod(F.xxhash64("key"), "blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    # behind the first shared value enough must be left in both lists
    left = F.col("n") - F.col("at")
    x = dealt.select("v", F.col("key").alias("a"), F.col("own").alias("i"), F.explode(every).alias("j"), left.alias("la"))
    y = dealt.select("v", F.col("key").alias("b"), F.col("own").alias("j"), F.explode(every).alias("i"), left.alias("lb"))
    # never broadcast: Spark's estimate of what is exploded is that of its source
    met = x.join(y.hint("merge"), ["v", "i", "j"]).where((F.col("a") < F.col("b")) & (F.least("la", "lb") >= least)).select("a", "b")
    if least == 1:
        return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    sides = [listed.select(F.col("key").alias(k), F.col("vs").alias(f"v{k}")) for k in "ab"]
    both = met.distinct().join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", F.size(F.array_intersect("va", "vb")).cast("long").alias("n")).where(F.col("n") >= least)


def set_similarity(sets: DataFrame, key: str, value: str, least: float, within: str | None = None) -> DataFrame:
    """Pairs (a, b, score) of keys whose value sets have a Jaccard similarity of at least ``least``.

    Keys with equal sets are a class: each is paired with the class's smallest key (score 1), and that key
    alone with those of other classes, so that a class of n keys gives n - 1 pairs and no set is compared twice.

    An exact prefix join: values are ordered by rarity, and each key posts only as many of its rarest as two
    similar sets can differ in, plus one; very common values therefore are hardly ever posted. A shared value
    must leave enough behind it in both lists. Candidates are confirmed on whole sets. Where all values are so
    common that postings would meet more often than pairs are worth, sets are multiplied in blocks. With
    ``within``, a column that each key has one value of, only keys that agree in it meet.
    """
    group = F.lit(0) if within is None else F.col(within)
    members, whole = set_classes(sets.select(F.col(key).alias("key"), F.xxhash64(value, group).alias("v")))
    members = members.select("a", "b", F.lit(1.0).alias("score"))
    listed = by_rarity(whole)
    prefix = F.slice("vs", 1, F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1)
    posted = listed.select("key", "n", F.posexplode(prefix).alias("at", "v"))
    if crowded(listed, posted):
        return block_pairs(listed, jaccard_from(least), "score double").unionByName(members)
    x, y = posted.alias("x"), posted.alias("y")
    sized = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * least
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    enough = left * (1 + least) >= (F.col("x.n") + F.col("y.n")) * least - 1e-6
    pairs = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.key") < F.col("y.key")) & sized & enough).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    sides = [listed.select(F.col("key").alias(k), F.col("vs").alias(f"v{k}")) for k in "ab"]
    scored = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("both", F.size(F.array_intersect("va", "vb")))
    score = F.col("both") / (F.size("va") + F.size("vb") - F.col("both"))
    return scored.where(score >= least).select("a", "b", (F.floor(score * 1e4 + 0.5) / 1e4).alias("score")).unionByName(members)


#: Buckets in which a task looks grams up before it gives them on: a bitmap of 2 MB, however many grams there are.
GRAM_BUCKETS = 1 << 24


def gram_buckets(g: np.ndarray) -> np.ndarray:
    return (g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def gram_bitmap(grams: DataFrame) -> np.ndarray:
    """Which of GRAM_BUCKETS hold any of the grams (g): a fixed size, whatever the input."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # bit positions count from 1
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(gram_buckets(batch.column(0).to_numpy(zero_copy_only=False))).view(np.int64) + 1)], ["x"])

    parts = grams.mapInArrow(buckets, "x long").groupBy(F.bitmap_bucket_number("x").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros(GRAM_BUCKETS, bool)
    for part, bits in parts.collect():
        some = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        out[(part - 1) * len(some) : part * len(some)] = some
    return out


def byte_grams(rows: DataFrame, key: str, data: str, positions: bool, wanted: np.ndarray | None = None, width: int = 8) -> DataFrame:
    """(key, n, g) of the substrings of 8 bytes, as longs: with their position ``at``, or each once.

    With ``wanted``, a bitmap as ``gram_bitmap`` makes it, grams in buckets that it lacks don't leave the task.
    """
    held = None if wanted is None else np.packbits(wanted, bitorder="little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = None if held is None else np.unpackbits(held, bitorder="little").astype(bool)
        columns, size = [[] for _ in range(4)], 0
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.empty(0, np.uint8)
                if len(whole) < width:
                    continue
                grams = np.lib.stride_tricks.sliding_window_view(whole, width)
                for start in range(0, len(grams), 1 << 20):
                    g = np.ascontiguousarray(grams[start : start + (1 << 20)]).view(np.int64)[:, 0]
                    at = np.arange(start, start + len(g))
                    if some is not None:
                        kept = some[gram_buckets(g)]
                        g, at = g[kept], at[kept]
                    if not positions:
                        g = np.unique(g)
                        at = np.zeros(len(g), np.int64)
                    for column, x in zip(columns, (np.full(len(g), k), np.full(len(g), len(whole)), at, g), strict=True):
                        column.append(x)
                    size += len(g)
                    # pieces of many short items go on together
                    if size >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["key", "n", "at", "g"])
                        columns, size = [[] for _ in range(4)], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["key", "n", "at", "g"])

    return rows.select(F.col(key).cast("long"), data).mapInArrow(cut, "key long, n long, at long, g long")


def byte_overlap(left: DataFrame, right: DataFrame, key: str, data: str, band: bool = True) -> DataFrame:
    """(a, b, covered, share): how many bytes of a's data lie in substrings of 8 bytes shared with b's.

    ``share`` is of the shorter item. ``left`` is a set of items to look for, ``right`` all items; with
    ``band``, only items of half to twice the size meet. Most grams of the right that the left doesn't have
    don't leave the task that makes them, by a bitmap of a fixed size, and the others go before anything is
    shuffled on them if the left's are few, which Spark decides by their size. Positions that several grams
    cover count once.
    """
    x = byte_grams(left, key, data, True)
    y = byte_grams(right, key, data, False, gram_bitmap(x.select("g"))).join(x.select("g").distinct(), "g", "left_semi")
    fits = in_band(F.col("x.n"), F.col("y.n")) if band else F.lit(True)
    hits = x.alias("x").join(y.alias("y"), (F.col("x.g") == F.col("y.g")) & fits)
    hits = hits.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.least("x.n", "y.n").alias("shorter"), F.col("x.at").alias("at"))
    # dealt by pair once, for repeats, the order of positions and the sums
    hits = hits.repartition("a", "b").distinct()
    ahead = F.lead("at").over(Window.partitionBy("a", "b").orderBy("at"))
    new = hits.withColumn("new", F.least(F.lit(8), F.coalesce(ahead - F.col("at"), F.lit(8))))
    covered = new.groupBy("a", "b", "shorter").agg(F.sum("new").alias("covered"))
    return covered.select("a", "b", "covered", F.least(F.lit(1.0), F.col("covered") / F.col("shorter")).alias("share"))


def hash_tier(items: DataFrame, key: str, digest: str) -> DataFrame:
    """Equal items as pairs with the first of them, score 1: a group of n gives n - 1 pairs, not all."""
    hubs = items.groupBy(digest).agg(F.min(key).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select(digest, "a")
    return items.join(hubs, digest).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"), F.lit(1.0).alias("score"), F.lit("hash").alias("kind"))


def related_entities(items: DataFrame, strings: DataFrame, asked: DataFrame, k: int, least: float = 0.3) -> DataFrame:
    """The k best partners of each entity in three tiers; a pair counts in the first tier that finds it (M3).

    ``items`` has id, family, data and data_hash, ``strings`` (id, family, string). Tiers: equal data (score
    1); a Jaccard similarity of at least ``least`` of the string sets in one family; for the items ``asked``
    for, against all, the mean of byte overlap and string similarity within the size band, from ``least`` up.
    Rows with null data take part by their strings only.
    """
    first = hash_tier(items.where(F.col("data_hash").isNotNull()), "id", "data_hash")
    second = set_similarity(strings, "id", "string", least, "family").select("a", "b", "score", F.lit("strings").alias("kind"))
    overlap = materialise(byte_overlap(asked, items, "id", "data").where("a <> b"), "overlap")
    # only overlaps that can reach the bound need their strings compared
    near = overlap.where((F.col("share") + 1) / 2 >= least).select("a", "b", "share")
    own = strings.select("id", "string").distinct()
    sizes = own.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = near.join(own.withColumnRenamed("id", "a"), "a").join(own.withColumnRenamed("id", "b"), ["b", "string"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    scored = near.join(both, ["a", "b"], "left").join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a", "left").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b", "left")
    n = F.coalesce("both", F.lit(0))
    either = F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)) - n
    score = (F.col("share") + F.when(either > 0, n / either).otherwise(0.0)) / 2
    third = scored.select("a", "b", F.round(score, 4).alias("score"), F.lit("bytes").alias("kind")).where(F.col("score") >= least)
    return related([first, second, third], k)


def related(tiers: list[DataFrame], k: int) -> DataFrame:
    """The k best partners of each entity; a pair counts in the first tier that has it.

    Each tier has (a, b, score, kind); both ends of a pair get the other as partner.
    """
    rows = None
    for n, tier in enumerate(tiers):
        tier = tier.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", "kind", F.lit(n).alias("tier"))
        rows = tier if rows is None else rows.unionByName(tier)
    best = rows.groupBy("a", "b").agg(F.min(F.struct("tier", (-F.col("score")).alias("minus"), "kind")).alias("x"))
    best = best.select("a", "b", (-F.col("x.minus")).alias("score"), "x.kind")
    both = best.unionByName(best.select(F.col("b").alias("a"), F.col("a").alias("b"), "score", "kind"))
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
