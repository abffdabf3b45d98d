"""N-gram Jaccard join as a blocked sparse matrix product of the document by n-gram incidence.

Rows of the matrix are classes of documents with equal n-gram sets, columns are n-grams, rarest first. Two
rows similar enough must share one of the first columns of both, as many as they can differ in plus one, so
only those entries are posted. Blocks of columns are multiplied by their own transpose: each gives partial
overlap counts of pairs of rows, which add up over blocks. A pair goes as soon as its count, with all that
later columns can add, stays below the overlap that its sizes ask for. What is left gets its whole overlap.

A column that very many rows share isn't multiplied by itself, as that would give all pairs of a group of
copies. Its rows are multiplied with two pivot rows first, then, round by round, rows of one component with
rows of others; what several components share even then is multiplied across components, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, settled, table
from .neardup import SKETCH, SKETCH_SQL, WholeSets, across_postings, bit_sketch, bucket_counts, class_of, grown, in_pieces, joined, named_components, plausible, row_check, row_hash, shingle_sets, sketch_columns, stars

#: Buckets in which n-grams are counted to order columns by rarity.
COLUMN_BUCKETS = 1 << 18
#: Columns with more rows than this aren't multiplied by themselves.
LONG_COLUMN = 16


def posted_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, row_hash, row_check, n_shingles, set_hi, set_lo (null without words), sketch columns and the first columns of each document, in order, as bytes."""
    seen = bucket_counts(docs, "text", lambda texts: in_pieces(shingle_sets(texts, words)), COLUMN_BUCKETS)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, high, low, firsts, bits = [], [], [], [], []
            for s in shingle_sets(batch.column(3), words):
                n = len(s)
                first = None
                if n:
                    # by rarity of the bucket, then by the n-gram itself: the same order in all documents
                    count, keep = seen[(s % np.uint64(COLUMN_BUCKETS)).astype(np.int64)], n - (-(-n * percent // 100)) + 1
                    if keep < n:
                        edge = np.partition(count, keep - 1)[keep - 1]
                        s_in, c_in = s[count <= edge], count[count <= edge]
                    else:
                        s_in, c_in = s, count
                    first = s_in[np.lexsort((s_in, c_in))][:keep].tobytes()
                hi, lo = class_of(s) if n else (None, None)
                for into, x in zip((sizes, high, low, firsts, bits), (n, hi, lo, first, bit_sketch(s)), strict=True):
                    into.append(x)
            made = [pa.array(x, t) for x, t in ((sizes, pa.int64()), (high, pa.int64()), (low, pa.int64()), (firsts, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made, *sketch_columns(bits)], ["doc_id", "row_hash", "row_check", "n_shingles", "set_hi", "set_lo", "firsts", *SKETCH])

    rows = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row_hash"), row_check().alias("row_check"), "text")
    return rows.mapInArrow(post, f"doc_id long, row_hash long, row_check long, n_shingles long, set_hi long, set_lo long, firsts binary, {SKETCH_SQL}")


def incidence(classes: DataFrame) -> DataFrame:
    """The entries (key, cls, size, place) that are posted of a row of n-grams, in columns with n > 1 rows."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
                lengths = [len(x) for x in own]
                repeat = [np.repeat(batch.column(i).to_numpy(), lengths) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(own), *repeat, np.concatenate([np.arange(n) for n in lengths]))], ["key", "cls", "size", "place"])

    posted = classes.select("cls", F.col("n").alias("size"), "firsts").mapInArrow(entries, "key long, cls long, size long, place long")
    # most n-grams occur once, so that keys alone are counted first
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return materialise(posted.join(shared, "key"), "entries")


def pivots(long: DataFrame) -> DataFrame:
    """Pairs (a, b) of each row of long columns with two pivot rows, the first by each of two hashes of those of its columns."""
    two = long.groupBy("key").agg(*(F.min(F.struct(F.xxhash64(F.lit(i), "cls"), "cls"))["cls"].alias(f"hub{i}") for i in (1, 2)))
    return stars(long.join(two, "key")).distinct()


def product(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the columns ``entries`` of at most LONG_COLUMN rows show, their counts and what later columns can add.

    Columns are dealt to blocks by hash; a task multiplies its blocks column by column, with pairs whose
    sizes alone rule them out left out, and adds up the pairs of a batch before Spark adds up all.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = np.zeros((4, 0), np.int64)
        for whole in (*batches, None):
            if whole is not None:
                now = np.column_stack([carried, np.stack([c.to_numpy() for c in whole.columns])])
                # the last column may go on in the next batch
                end = int(np.searchsorted(now[0], now[0, -1])) if now.shape[1] else 0
                now, carried = now[:, :end], now[:, end:]
            else:
                now = carried
            key, cls, size, place = now
            found = []
            for step in range(1, LONG_COLUMN):
                i = np.flatnonzero(key[step:] == key[:-step]) if step < len(key) else np.zeros(0, np.int64)
                if not len(i):
                    break
                j = i + step
                fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
                i, j = i[fits], j[fits]
                after = np.minimum(size[i] - place[i], size[j] - place[j]) - 1
                found.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), after, size[i] + size[j]]))
            if not found:
                continue
            a, b, after, sizes = np.column_stack(found)
            order = np.lexsort((after, b, a))
            a, b, after, sizes = a[order], b[order], after[order], sizes[order]
            first = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))) if len(a) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(a)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], counts, after[first], sizes[first])], ["a", "b", "overlap", "after", "sizes"])

    blocks = entries.select("key", "cls", "size", "place").repartition("key").sortWithinPartitions("key")
    parts = blocks.mapInArrow(multiply, "a long, b long, overlap long, after long, sizes long")
    return parts.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.min("after").alias("after"), F.first("sizes").alias("sizes"))


def candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a column of at most LONG_COLUMN rows and whose overlap may reach what their sizes ask for.

    After the last column that a pair shares here, the smaller of both rests bounds what is to come; up to
    there, what isn't counted can only be in long columns, of which no more than both rows have count.
    """
    pairs = product(entries.where(F.col("n") <= LONG_COLUMN), percent)
    longs = entries.where(F.col("n") > LONG_COLUMN).groupBy("cls").agg(F.count(F.lit(1)).alias("longs"))
    for side in "ab":
        pairs = pairs.join(longs.select(F.col("cls").alias(side), F.col("longs").alias(f"long_{side}")), side, "left")
    unseen = F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0)))
    return pairs.where((F.col("overlap") + unseen + F.col("after")) * (100 + percent) >= percent * F.col("sizes")).select("a", "b")


def class_roots(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of the components of classes; classes without links are absent."""
    entries, sets = incidence(classes), WholeSets(classes, docs, words)
    long = entries.where(F.col("n") > LONG_COLUMN)
    near = materialise(candidates(entries, percent).unionByName(pivots(long)).distinct(), "candidates")
    near = materialise(plausible(near, classes, percent), "near")

    def last(named: DataFrame) -> DataFrame:
        # the first column that a linked pair shares leaves enough after it in both rows
        posts = named.join(entries.select("key", "cls", "place"), ["key", "cls"]).join(classes.select("cls", "n", *SKETCH), "cls")
        posts = posts.select(F.col("key").alias("shingle"), (F.col("n") - F.col("place")).alias("rest"), "cls", "root", "n", *SKETCH)
        return across_postings(materialise(posts, "posts"), percent)

    return grown(joined(near, sets, percent), near, long.select("key", "cls"), classes, sets, percent, last)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Component of the links of an exact n-gram Jaccard join for each row.

    Reads doc_id and text. Words are runs of anything but ASCII white space, A-Z lower-cased; a document's
    set holds its distinct n-grams of ``words`` words, or its whole sequence if it has fewer. Two documents
    are linked if 100 times their intersection is at least ``percent`` times their union; n-grams go by 64
    bits, sets by 128, and no link is left to chance. Returns doc_id, row_hash (of id and text), n_shingles,
    component_id (the smallest doc_id reachable, itself included), kept and root, as ``near_duplicates``
    does, of which this is the exact form. Rows without words or text are linked with nothing; a null doc_id
    is never the smallest unless all are null; repeated rows each get a row. An empty table gives no rows.
    """
    rows = materialise(posted_rows(docs, words, percent), "posted")
    of_set = rows.where(F.col("set_hi").isNotNull()).groupBy("set_hi", "set_lo")
    classes = of_set.agg(F.first("firsts").alias("firsts"), F.first("n_shingles").alias("n"), *(F.first(s).alias(s) for s in SKETCH), F.min(F.struct("doc_id", "row_hash", "row_check")).alias("rep"), F.min("doc_id").alias("least"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    return named_components(rows, classes, settled(lambda: class_roots(classes, docs, words, percent), "roots"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


#: All pairs of documents that share an n-gram, compared on whole sets.
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
  SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)
), u AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS v, doc_id AS m FROM s UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.v AND r.m < u.b
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.m) AS component_id
FROM s JOIN r ON r.v = s.doc_id GROUP BY s.doc_id, s.s
"""
