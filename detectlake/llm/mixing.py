"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight. Within its source the documents are
sorted by key and their sizes prefix-summed; complete passes (epochs) over a source come first and the
sorted prefix that fills what is left of the target follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, word_count

#: Weights of the sources in code-point order, repeating.
CYCLE = (5, 2, 1)


def quality_weight(text: Column) -> Column:
    """A weight in [0.05, 1]: the share of a text that isn't symbols, squared. Empty or null text: 1."""
    symbols = F.regexp_count(text, F.lit(r"[|!#$%&*<>{}\[\]=_~^@\\/+]"))
    share = F.lit(1.0) - symbols / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), share * share), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = CYCLE, most_epochs: int = 3) -> DataFrame:
    """Targets by source from (source, source_size), one row a source.

    The sum of all sizes is shared by weight; a target stops at ``most_epochs`` times its source's size and
    the excess is shared again by weight among the rest. Sorted by the level at which a source fills up, the
    sources that are full form a prefix, so that one pass of sums gives what resharing would.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    rows = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", (F.col("source_size") * most_epochs).cast("double"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy()).cast("double"),
            "full_before": F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_left": F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("rate", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    rows = rows.withColumn("full", F.col("cap") <= F.col("weight") * F.col("rate"))
    # the first source that doesn't fill up sets the rate for all after it
    rate = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("rate").alias("rate")))).over(Window.partitionBy())["rate"]
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rate).alias("target"))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = CYCLE,
    most_epochs: int = 3,
    quality: str | None = None,
    buckets: int = 4_096,
    run: int = 10_000,
    seed: str = "mix-1",
) -> DataFrame:
    """How often each document is taken so that each source meets its target of words.

    Returns doc_id, source, size, source_size, target, copies, taken (``size * copies``) and row_hash (of id
    and text). Copies are the complete epochs that fit the target, plus one for the sorted prefix that fits
    the rest and for the one further document that brings the sum nearest to the target. Keys come from
    hashes, so reruns agree. Weights are those in the column ``quality`` (null counts as 1, less than 0.05 as
    that), or ``quality_weight`` of the text. Null text has size 0; documents without words take part in
    complete epochs only by count. Null sources are a source of their own, sorted last. An empty table gives
    no rows.

    No source is sorted in one task: keys fall into ``buckets`` ranges, sums by range give the offset of
    each, and only within a range are keys sorted. Rows that are equal in all of this are counted and sorted
    as runs of at most ``run``, each run with a key of its own, so that a row that is repeated very often
    doesn't gather in one range.
    """
    # 52 bits of a digest of id and text: alike on every run and in every engine
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    weight = F.greatest(F.lit(0.05), F.coalesce(F.col(quality).cast("double"), F.lit(1.0))) if quality else quality_weight(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), digest.alias("digest"), weight.alias("weight"), F.xxhash64(doc_id, text).alias("row_hash"))
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows"))
    runs = counted.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(run).cast("long")))).withColumn("n", F.least(F.col("rows") - F.col("at"), F.lit(run)))
    own = F.when(F.col("at") == 0, F.col("digest")).otherwise(F.md5(F.concat("digest", F.col("at").cast("string"))))
    uniform = (F.conv(F.substring(own, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    keyed = runs.select("doc_id", "source", "size", "row_hash", "at", "n", (-F.log(uniform) / F.col("weight")).alias("draw"))
    # e^-key is uniform at weight 1 and nearer to 0 below it; ranges needn't be even, only in order
    keyed = materialise(keyed.withColumn("part", F.floor((F.lit(1.0) - F.exp(-F.col("draw") / 2)) * buckets).cast("int")), "keyed")
    words = F.col("size") * F.col("n")
    parts = keyed.groupBy("source", "part").agg(F.sum(words).alias("words"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most_epochs)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    plan = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "part", "offset", "source_size", "target")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = keyed.alias("k").join(plan.alias("q"), F.col("k.source").eqNullSafe(F.col("q.source")) & (F.col("k.part") == F.col("q.part")))
    rows = rows.select("doc_id", "k.source", "size", "n", "at", "draw", "row_hash", "k.part", "offset", "source_size", "target", "epochs", "budget")
    within = Window.partitionBy("source", "part").orderBy("draw", "doc_id", "row_hash", "size", "at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("offset") + F.coalesce(F.sum(words).over(within), F.lit(0)))
    # so many rows of the run fit the budget
    fit = F.when(F.col("size") > 0, F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("budget") - F.col("before")) / F.col("size")).cast("long")))).otherwise(F.lit(0))
    rows = rows.withColumn("fit", fit)
    # One document a source closes what the prefix leaves open, if it makes the sum nearer. The prefix ends
    # inside one part; what it holds is a maximum of running sums, so both are plain aggregates.
    upto = F.col("before") + F.col("size") * F.col("fit")
    gap = rows.groupBy("source").agg(F.max(F.when(upto <= F.col("budget"), upto)).alias("held"))
    rest = rows.where((F.col("fit") < F.col("n")) & (F.col("size") > 0)).alias("r").join(gap.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    off = F.abs(F.col("budget") - F.coalesce(F.col("held"), F.lit(0)) - F.col("size"))
    nearer = rest.where(off < F.col("budget") - F.coalesce(F.col("held"), F.lit(0))).groupBy("r.source").agg(F.min(F.struct(off.alias("off"), "draw", "doc_id", "row_hash", "at", "before")).alias("close"))
    rows = rows.alias("r").join(nearer.alias("n"), F.col("r.source").eqNullSafe(F.col("n.source")), "left")
    closes = (F.col("close.row_hash") == F.col("r.row_hash")) & F.col("close.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("close.before") == F.col("r.before")) & (F.col("close.at") == F.col("r.at"))
    once_more = F.col("fit") + F.coalesce(closes, F.lit(False)).cast("long")
    shares = F.array(F.struct(F.col("epochs").alias("copies"), (F.col("r.n") - once_more).alias("n")), F.struct((F.col("epochs") + 1).alias("copies"), once_more.alias("n")))
    rows = rows.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", "row_hash", F.explode(F.filter(shares, lambda x: x["n"] > 0)).alias("x"))
    each = rows.select("*", F.col("x.copies").alias("copies"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.n"))))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "row_hash")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows, with each source sorted as a whole.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / coalesce(greatest(0.05, pow(1.0 - len(regexp_extract_all(text, '[|!#$%&*<>{}\[\]=_~^@\\/+]')) / greatest(length(text), 1), 2)), 1.0) AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS w FROM d GROUP BY 1
), c AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM c
), t AS (
  SELECT source, source_size, CASE WHEN cap <= w * rate THEN cap ELSE w * (SELECT arg_min(rate, cap / w) FROM l WHERE cap > w * rate) END AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT d.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), h AS (
  SELECT source, coalesce(max(upto) FILTER (upto <= budget), 0) AS held FROM r GROUP BY 1
), n AS (
  SELECT r.source, arg_min({'doc_id': doc_id, 'upto': upto}, {'off': abs(budget - held - size), 'draw': draw}) AS best
  FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source WHERE upto > budget AND size > 0 AND abs(budget - held - size) < budget - held GROUP BY 1
)
SELECT r.doc_id, r.size, r.source_size, r.target,
  r.size * (r.epochs + CASE WHEN (r.upto <= r.budget AND r.size > 0) OR coalesce(n.best.doc_id = r.doc_id AND n.best.upto = r.upto, false) THEN 1 ELSE 0 END) AS taken
FROM r LEFT JOIN n ON r.source IS NOT DISTINCT FROM n.source
"""
