"""Near-duplicate groups by a signature-coordinate inverted join over MinHash signatures.

Documents with equal shingle sets form a class. A class is posted under the coordinate-value pairs of its
signature, each coordinate two MinHash values in one, so that chance agreements stay rare as the corpus
grows; two classes that agree in at least ``match`` of ``hashes`` coordinates must share one of the
``hashes - match + 1`` first pairs in any fixed order of all pairs, so only those are posted, rarest first.
Very common pairs (passages that many documents share) thus are skipped unless little else is there. A class
first meets two hubs of its lists, chosen by hash; candidates are kept if enough coordinates agree. In a
short list then all members of different components meet. For long ones come rounds in which a member meets
a few of the other components in its lists, so that a dense group grows together by pairs in proportion to its
members. What rounds no longer join meets by the rarest shingles of whole sets, again across components only.
Sketches of sets rule pairs out before whole sets are made; all links are confirmed on whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, mix64, settled, table, text_slices, word_hashes
from .components import hung, star_edges, star_round, tied

HASHES = 64
#: MinHash values in a coordinate.
ROWS = 2
#: Bits of the sketch that pairs are held against before whole sets are, and its columns.
BITS = 1024
SKETCH = [f"s{i}" for i in range(BITS // 64)]
SKETCH_SQL = ", ".join(f"{s} long" for s in SKETCH)
#: Buckets in which coordinate-value pairs are counted to order them by rarity.
RARITY_BUCKETS = 1 << 16
#: Up to this length, all members of a list meet.
SHORT_LIST = 8
#: Rounds between components, and more as long as each leaves fewer of them in mixed lists by more than a share.
ROUNDS, FRUITFUL = 3, 0.02
#: Members of other components that a class meets in a round.
MEETS = 4
#: Up to so many rows that are asked for go to all tasks; of more, a mark each in this many bits does.
SENT, MARKS = 10_000, 1 << 22
_RANDOM = np.random.default_rng(7)
_FACTORS, _SHIFTS = (_RANDOM.integers(0, 1 << 63, HASHES * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has one, its whole sequence."""
    for _, data, starts in text_slices(texts):
        hashes, of = word_hashes(data, starts[:-1])
        bounds = np.searchsorted(of, np.arange(len(starts)))
        rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for j in range(words):
            rolled = mix64(rolled + hashes[j : j + len(rolled)])
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if high - low >= words:
                yield np.unique(rolled[low : high - words + 1])
            elif high > low:
                short = np.zeros(1, np.uint64)
                for j in range(low, high):
                    short = mix64(short + hashes[j : j + 1])
                yield mix64(short ^ np.uint64(high - low))
            else:
                yield rolled[:0]


def least_values(shingles: np.ndarray, first: int, count: int) -> np.ndarray:
    """The smallest value of each of ``count`` hash functions over a set."""
    least = np.full(count, 0xFFFFFFFF, np.uint64)
    factors, shifts = _FACTORS[first : first + count], _SHIFTS[first : first + count]
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[at : at + 2048, None] * factors + shifts) >> np.uint64(32)).min(0))
    return least


def signature(shingles: np.ndarray) -> np.ndarray:
    """The coordinates of a set: each a hash of ROWS smallest values."""
    values = least_values(shingles, 0, HASHES * ROWS).reshape(HASHES, ROWS)
    whole = np.zeros(HASHES, np.uint64)
    for j in range(ROWS):
        whole = mix64(whole + values[:, j])
    return (whole >> np.uint64(32)).astype(np.uint32)


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parities of a set's number of shingles in each of BITS buckets, as longs.

    As many parities of two sets differ as shingles are in one of them only, or fewer.
    """
    bits = np.bincount((shingles >> np.uint64(64 - 10)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch_columns(bits: list[np.ndarray]) -> list[pa.Array]:
    """The sketches of a batch's sets, column by column."""
    return [pa.array(x) for x in np.array(bits, np.int64).reshape(-1, len(SKETCH)).T.copy()]


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two longs."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def match_threshold(percent: int, hashes: int = HASHES, lost: float = 1e-6) -> int:
    """The most coordinates in which a pair at the similarity bound agrees, but with a probability of at most ``lost``."""
    p, below = (percent / 100) ** ROWS, 0.0
    for match in range(hashes):
        below += math.comb(hashes, match) * p**match * (1 - p) ** (hashes - match)
        if below > lost:
            return max(1, match)
    return hashes


def not_ruled_out(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches of two sets, in columns behind the prefixes ``x`` and ``y``, allow a link.

    Sets at the bound differ in (100 - percent) / (100 + percent) of the sum of their sizes, so in no more
    parities: no link is ruled out.
    """
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"{x}{s}").bitwiseXOR(F.col(f"{y}{s}"))) for s in SKETCH))
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return sizes & (differ * (100 + percent) <= (n + m) * (100 - percent))


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def row_check() -> Column:
    """64 more bits of a row's id and text: both hashes together stand for the row."""
    return F.xxhash64(F.lit(1), "doc_id", "text")


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row_hash, row_check, n_shingles, set_hi, set_lo (null without words), signature and sketch columns of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, signatures, bits = [], [], [], []
            for s in shingle_sets(batch.column(3), words):
                sizes.append(len(s))
                classes.append(class_of(s) if len(s) else (None, None))
                signatures.append(signature(s).tobytes() if len(s) else None)
                bits.append(bit_sketch(s))
            high, low = zip(*classes, strict=True) if classes else ((), ())
            made = [pa.array(x, t) for x, t in ((sizes, pa.int64()), (high, pa.int64()), (low, pa.int64()), (signatures, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made, *sketch_columns(bits)], ["doc_id", "row_hash", "row_check", "n_shingles", "set_hi", "set_lo", "signature", *SKETCH])

    rows = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row_hash"), row_check().alias("row_check"), "text")
    return rows.mapInArrow(sign, f"doc_id long, row_hash long, row_check long, n_shingles long, set_hi long, set_lo long, signature binary, {SKETCH_SQL}")


def pair_keys(signatures: pa.Array) -> np.ndarray:
    """A 64-bit key for each coordinate-value pair of each signature."""
    values = np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(-1, HASHES)
    return mix64((np.arange(HASHES, dtype=np.uint64) << np.uint64(32)) + values + np.uint64(1))


def in_pieces(arrays: Iterable[np.ndarray], most: int = 1 << 18) -> Iterator[np.ndarray]:
    """Arrays joined up to about ``most`` entries at a time, so that a batch's aren't held together."""
    held, size = [], 0
    for x in arrays:
        held.append(x)
        size += len(x)
        if size >= most:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def bucket_counts(rows: DataFrame, column: str, keys: Callable[[pa.Array], Iterable[np.ndarray]], buckets: int = RARITY_BUCKETS) -> np.ndarray:
    """How often the keys of a column occur over all rows, in a number of buckets (a fixed size, whatever the input)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in keys(batch.column(0)) if len(batch) else ():
                total += np.bincount((piece % np.uint64(buckets)).astype(np.int64).ravel(), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = rows.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[counted["bucket"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


def postings(classes: DataFrame, match: int) -> DataFrame:
    """(key, cls, n, hub1, hub2) for the rarest ``HASHES - match + 1`` pairs of each class, in lists of n > 1 classes.

    The hubs are two members of the list, chosen by two hashes.
    """
    seen, prefix = bucket_counts(classes, "signature", lambda column: [pair_keys(column)]), HASHES - match + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys = pair_keys(batch.column(1))
            # a pair's rank is a function of the pair alone: the count of its bucket, then its key
            order = np.lexsort((keys, seen[(keys % np.uint64(RARITY_BUCKETS)).astype(np.int64)]), axis=1)[:, :prefix]
            rare = np.take_along_axis(keys, order, 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rare.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), prefix))], ["key", "cls"])

    posted = classes.select("cls", "signature").mapInArrow(post, "key long, cls long")
    hubs = [F.min(F.struct(F.xxhash64(F.lit(i), "cls"), "cls"))["cls"].alias(f"hub{i}") for i in (1, 2)]
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *hubs).where(F.col("n") > 1)
    return materialise(posted.join(shared, "key"), "postings")


def stars(long: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of lists (cls, hub1, hub2) with two hubs each: the first by each hash of all lists that hold a member.

    A dense group thus meets few hubs, and a member two of them, however many lists it is in. What that
    doesn't join is met list by list, between components.
    """
    of = [F.min(F.when(F.col(h) != F.col("cls"), F.struct(F.xxhash64(F.lit(i), h).alias("order"), F.col(h).alias("hub"))))["hub"] for i, h in ((1, "hub1"), (2, "hub2"))]
    met = long.groupBy("cls").agg(F.array(*of).alias("hubs")).select("cls", F.explode("hubs").alias("hub"))
    return met.where(F.col("hub").isNotNull()).select(*ordered("cls", "hub"))


def agreeing(pairs: DataFrame, classes: DataFrame, match: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least ``match`` coordinates."""
    sides = [classes.select(F.col("cls").alias(k), F.col("signature").alias(f"s{k}")) for k in "ab"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            yield batch.filter(pa.array((x == y).sum(1) >= match)).select(["a", "b"])

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long")


def marked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose row_hash has the mark of one that is asked for; few others have it. MARKS bits at most go to all tasks."""
    word, bit = F.expr(f"pmod(row_hash, {MARKS}L) DIV 64"), "CAST(pmod(row_hash, 64L) AS INT)"
    marks = asked.groupBy(word.alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("marks"))
    found = rows.withColumn("word", word).join(F.broadcast(marks), "word").where(f"(shiftright(marks, {bit}) & 1L) = 1L")
    return found.drop("word", "marks")


class WholeSets:
    """The whole shingle sets of classes (cls, rep), each made when it is first asked for, from one text of its class."""

    def __init__(self, classes: DataFrame, docs: DataFrame, words: int):
        self.classes, self.docs, self.words, self.made = classes, docs, words, None

    def of(self, asked: DataFrame) -> DataFrame:
        """(cls, shingles) of the classes (cls) asked for, and of those that were before."""
        asked = asked.select("cls").distinct()
        missing = asked if self.made is None else asked.join(self.made.select("cls"), "cls", "left_anti")
        # written first: its size is known then, and texts that no class asks for aren't shuffled
        reps = materialise(self.classes.select("cls", "rep").join(missing, "cls").select("cls", "rep.row_hash", "rep.row_check"), "reps")
        n = reps.count()
        if self.made is None or n:
            now = materialise(self._sets(reps, n), "sets")
            self.made = now if self.made is None else self.made.unionByName(now)
        return self.made

    def _sets(self, reps: DataFrame, n: int) -> DataFrame:
        words = self.words
        keyed = self.docs.select(row_hash().alias("row_hash"), row_check().alias("row_check"), "text")
        keyed, reps = (keyed, F.broadcast(reps)) if n <= SENT else (marked(keyed, reps), reps)
        # rows that are equal in id and text lie together behind the join, where one of them is kept
        texts = keyed.join(reps, ["row_hash", "row_check"]).dropDuplicates(["row_hash", "row_check"]).select("cls", "text")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    some = batch.slice(at, 256)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for s in shingle_sets(some.column(1), words)], pa.binary())], ["cls", "shingles"])

        return texts.mapInArrow(sets, "cls long, shingles binary")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches of classes (cls, n, sketch columns) don't rule out."""
    sides = [classes.select(*(F.col(c).alias(k if c == "cls" else f"{k}{c}") for c in ("cls", "n", *SKETCH))) for k in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(not_ruled_out("a", "b", percent)).select("a", "b")


def confirmed(pairs: DataFrame, sets: WholeSets, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough."""
    whole = sets.of(pairs.select(F.explode(F.array("a", "b")).alias("cls")))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    few = F.broadcast if pairs.count() <= SENT else DataFrame.distinct
    sides = [whole.join(few(pairs.select(F.col(k).alias("cls"))), "cls", "left_semi").select(F.col("cls").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab"]
    if few is F.broadcast:
        # the join with the pairs leaves out what isn't in them
        sides[0], pairs = whole.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), F.broadcast(pairs)
    found = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb").mapInArrow(similar, "a long, b long")
    return materialise(found, "links")


def ordered(x: str | Column, y: str | Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def mixed_lists(named: DataFrame) -> DataFrame:
    """The rows (key, cls, root) of lists that hold several roots."""
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("key")
    return named.join(mixed, "key")


def between_components(named: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of members of different roots: MEETS for each class in the lists (key, cls, root) at most, however many it is in.

    The commonest root of a list, which a dense group soon is, and those that come first and last by a hash each
    send one member. Of the other roots that its lists send, a class meets those that most of them send. The
    hashes differ by ``turn``.
    """
    one = F.min(F.struct(F.xxhash64(F.lit(turn), "cls").alias("c"), "cls")).alias("one")
    each = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"), one).withColumn("r", F.xxhash64(F.lit(turn), "root"))
    places, sides = F.struct("r", "root", "one"), ("most", "low", "high")
    sent = each.groupBy("key").agg(F.max(F.struct("k", "r", "root", "one")).alias("most"), F.min(places).alias("low"), F.max(places).alias("high"))
    rows = named.join(sent, "key")
    met = rows.select("cls", "root", F.explode(F.array(*(F.struct(f"{x}.r", F.col(f"{x}.root").alias("of"), f"{x}.one") for x in sides))).alias("x")).where(F.col("root") != F.col("x.of"))
    roots = met.select("cls", "x.*").groupBy("cls", "r", "of").agg(F.count(F.lit(1)).alias("n"), F.min("one")["cls"].alias("other"))
    first = Window.partitionBy("cls").orderBy(F.desc("n"), "r", "of")
    return roots.withColumn("place", F.row_number().over(first)).where(F.col("place") <= MEETS).select(*ordered("cls", "other")).distinct()


def across(members: DataFrame, classes: DataFrame, sets: WholeSets, percent: int) -> DataFrame:
    """Pairs (a, b) of members (cls, root) with different roots that whole sets don't rule out.

    A set is posted under its rarest shingles, as many as two sets can differ in at the bound, plus one. Of
    a similar pair, the first shared one leaves enough shingles behind it in both: that condition is part of
    the join, and it rules out what only shares the body of a text with a dense group. Sketches, in the join
    too, rule out most of what else has a rare shingle in common. Under a shingle, only what isn't of its
    commonest root meets all others, so that a large component isn't held against itself.
    """
    own = members.join(sets.of(members), "cls")
    seen = bucket_counts(own, "shingles", lambda column: in_pieces(np.frombuffer(v.as_buffer(), np.uint64) for v in column))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True), batch.column(batch.num_columns - 1), strict=True):
                own = np.frombuffer(value.as_buffer(), np.uint64)
                n = len(own)
                first = own[np.lexsort((own, seen[(own % np.uint64(RARITY_BUCKETS)).astype(np.int64)]))][: n - (-(-n * percent // 100)) + 1]
                k = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first.view(np.int64), n - np.arange(k), *(np.full(k, x) for x in row))], ["shingle", "rest", *batch.schema.names[:-1]])

    columns = ["cls", "root", "n", *SKETCH]
    posted = own.join(classes.select("cls", "n", *SKETCH), "cls").select(*columns, "shingles").mapInArrow(post, ", ".join(f"{c} long" for c in ("shingle", "rest", *columns)))
    return across_postings(materialise(posted, "prefixes"), percent)


def across_postings(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots that meet under a shingle of postings (shingle, rest, cls, root, n, sketch columns) and may be linked."""
    columns = ["cls", "root", "n", *SKETCH]
    counted = posted.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle")
    common = counted.agg(F.max(F.struct("k", "root"))["root"].alias("common"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("shingle", "common")
    rows = materialise(posted.join(common, "shingle"), "mixed")
    name = lambda p: rows.select(F.col("shingle"), *(F.col(c).alias(f"{p}{c}") for c in ("common", "rest", *columns)))
    x, y = name("x").where(F.col("xroot") != F.col("xcommon")), name("y").withColumnRenamed("shingle", "other")
    enough = F.least("xrest", "yrest") * (100 + percent) >= percent * (F.col("xn") + F.col("yn"))
    once = (F.col("xroot") != F.col("yroot")) & ((F.col("yroot") == F.col("ycommon")) | (F.col("xcls") < F.col("ycls")))
    pairs = x.join(y, (F.col("shingle") == F.col("other")) & once & enough & not_ruled_out("x", "y", percent))
    return pairs.select(*ordered("xcls", "ycls")).distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that no component (node, root) holds both of."""
    for side in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def extended(edges: DataFrame, pairs: DataFrame, sets: WholeSets, percent: int) -> DataFrame:
    """The edges of components after those of further pairs (a, b) that are links; without pairs nothing is run."""
    return edges if pairs.isEmpty() else tied(edges, confirmed(pairs, sets, percent))


def located(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, cls, root) of lists (key, cls)."""
    return lists.select("key", "cls").join(hung(edges).withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))


def class_links(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of the components of classes; classes without links are absent.

    Members of lists meet two hubs each. Members of a short list that hold different components then all
    meet; those of long ones meet, round by round, members of components other than their own, as long as
    that finds links, and at last in an exact join. Every link has a list in common, so none between components
    is lost, and pairs inside a component, which may be as many as the square of its size, aren't made.
    """
    match, sets = match_threshold(percent), WholeSets(classes, docs, words)
    lists = postings(classes, match)
    near = materialise(agreeing(stars(lists).distinct(), classes, match), "candidates")
    near = materialise(plausible(near, classes, percent), "near")
    edges = joined(near, sets, percent)
    placed = located(lists.where(F.col("n") <= SHORT_LIST), edges)
    x, y = placed.alias("x"), placed.alias("y")
    other = (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
    pairs = x.join(y, other).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    short = materialise(agreeing(pairs, classes, match), "candidates")
    short = materialise(plausible(short, classes, percent), "near")
    edges = extended(edges, short, sets, percent)
    long = lists.where(F.col("n") > SHORT_LIST).select("key", "cls")
    return grown(edges, near.unionByName(short), long, classes, sets, percent, lambda named: across(materialise(named.select("cls", "root").distinct(), "members"), classes, sets, percent))


def joined(near: DataFrame, sets: WholeSets, percent: int) -> DataFrame:
    """Edges (a, b) that join the candidates (a, b) that are links, by a few rounds: what they leave apart may be one component still."""
    # each class first meets the least of its candidates; what that joins needn't be compared again
    first = materialise(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    edges = star_round(star_round(confirmed(first, sets, percent)))
    rest = materialise(apart(near.join(first, ["a", "b"], "left_anti"), hung(edges)), "rest")
    return extended(edges, rest, sets, percent)


def grown(edges: DataFrame, tried: DataFrame, named: DataFrame, classes: DataFrame, sets: WholeSets, percent: int, last: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of components, from the edges that first candidates (a, b), which were tried, gave, and long lists (key, cls).

    Round by round, members of a list that still holds several components meet members of others; what
    ``last`` makes of the lists (key, cls, root) that hold several even then meets once more, exactly. A round of
    stars follows each round here, and as many as it takes come before ``last`` and at the end: until then
    some of a component may count as another, which costs pairs and loses none.
    """
    left = None
    for turn in count():
        named = materialise(mixed_lists(located(named, edges)), "named")
        before, left = left, named.select("root").distinct().count()
        if not left:
            return hung(star_edges(edges))
        if before == left or (turn >= ROUNDS and left > (1 - FRUITFUL) * before):
            break
        fresh = materialise(between_components(named, turn).join(tried, ["a", "b"], "left_anti"), "fresh")
        met = materialise(plausible(fresh, classes, percent), "met")
        edges, tried = extended(edges, met, sets, percent), tried.unionByName(met)
    whole = star_edges(edges)
    if whole is not edges:
        named = materialise(mixed_lists(located(named, whole)), "named")
    crossing = materialise(last(named).join(tried, ["a", "b"], "left_anti"), "across")
    return hung(star_edges(extended(whole, crossing, sets, percent)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Component of near-duplicate links for each row.

    Reads doc_id and text. Words are runs of anything but ASCII white space, A-Z lower-cased; a document's
    set holds its distinct shingles of ``words`` words, or its whole sequence if it has fewer. Two documents
    are linked if 100 times their intersection is at least ``percent`` times their union. Returns doc_id,
    row_hash (of id and text), n_shingles, component_id (the smallest doc_id reachable, itself included),
    kept (doc_id is component_id) and root, which names the component whatever ids it holds: components
    without an id, or with the same smallest id, differ in it. Rows without words or text are linked with
    nothing and have no root; a null doc_id is never the smallest unless all are null; repeated rows each
    get a row. An empty table gives no rows.
    """
    rows = materialise(signed(docs, words), "signed")
    of_set = rows.where(F.col("set_hi").isNotNull()).groupBy("set_hi", "set_lo")
    classes = of_set.agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n"), *(F.first(s).alias(s) for s in SKETCH), F.min(F.struct("doc_id", "row_hash", "row_check")).alias("rep"), F.min("doc_id").alias("least"))
    # a class goes by a number of its own, kept with the written table
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    return named_components(rows, classes, settled(lambda: class_links(classes, docs, words, percent), "roots"))


def named_components(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The result for each row, from its set (set_hi, set_lo), the classes of sets and the roots of classes."""
    placed = classes.select("cls", "set_hi", "set_lo", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("set_hi", "set_lo", "least", F.coalesce("root", "cls").alias("root"))
    names = placed.join(placed.groupBy("root").agg(F.min("least").alias("component")), "root")
    found = rows.join(names, ["set_hi", "set_lo"], "left")
    component = F.when(F.col("set_hi").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return found.select("doc_id", "row_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "root")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs of documents that share a shingle, compared on whole sets.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM t
), e AS (
  SELECT doc_id, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), u AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS v, doc_id AS m FROM s UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.v AND r.m < u.b
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.m) AS component_id, s.doc_id = min(r.m) AS kept
FROM s JOIN r ON r.v = s.doc_id GROUP BY s.doc_id, s.s
"""
