"""Window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, by: str | list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; the plan limits groups before the shuffle (WindowGroupLimit)."""
    by = [by] if isinstance(by, str) else by
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def with_truncated(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group and whether the group has more; counts are partial aggregates, so a large entity isn't gathered for them."""
    sizes = df.groupBy(by).agg((F.count(F.lit(1)) > n).alias("truncated"))
    return top_n_per_group(df, by, order, n).join(sizes, by)


def representative_selection(df: DataFrame, by: str, order: str, cap: int) -> DataFrame:
    """At most ``cap`` rows: first the first row of every group, then others, both in order.

    A limit over a sort is a top-k operator: each task keeps ``cap`` rows. Rows of a group with the same
    ``order`` count in the order of their JSON, so that one of them comes first. Fails if there are more
    groups than ``cap``, as a group would be lost without a word.
    """
    groups = df.select(by).distinct().limit(cap + 1).count()
    if groups > cap:
        raise ValueError(f"a selection of {cap} rows can't hold one of each of more than {cap} groups")
    tie = F.to_json(F.struct(*df.columns))
    first = df.groupBy(by).agg(F.min(F.struct(F.col(order).alias("o"), tie.alias("t"))).alias("__x")).withColumnRenamed(by, "__by")
    rows = df.withColumn("__t", tie).join(first, F.col(by).eqNullSafe(F.col("__by")))
    is_first = (F.col(order).eqNullSafe(F.col("__x.o"))) & (F.col("__t") == F.col("__x.t"))
    return rows.withColumn("first", is_first).orderBy(F.desc("first"), order, "__t").limit(cap).drop("__by", "__x", "__t")


#: Bytes of a file whose records are ordered together.
SPAN = 1 << 22


def assign_blocks(records: DataFrame, begin: Column, end: Column, carry: dict[str, Column] | None = None, span: int = SPAN) -> DataFrame:
    """The record that begins the block around each record; null outside of blocks.

    Reads path and offset. A block counts only if an end marker follows its begin before the next begin; its
    key is the begin record's offset. Markers belong to no block. ``carry`` gives columns of the begin record
    to its block's records. Records are ordered within ``span`` bytes of a file; of each span only its first
    and last marker go on to the others, so that a file of any size is many tasks' work.
    """
    carry = carry or {}
    mark = F.when(begin, F.lit("b")).when(end, F.lit("e"))
    told = F.when(mark.isNotNull(), F.struct(mark.alias("mark"), F.col("offset").alias("at"), *(F.when(begin, v).alias(k) for k, v in carry.items())))
    rows = records.withColumn("__told", told).withColumn("__span", F.floor(F.col("offset") / span))
    marks = rows.where(F.col("__told").isNotNull()).groupBy("path", "__span").agg(F.min_by("__told", "offset").alias("first"), F.max_by("__told", "offset").alias("last"))
    # spans without a marker, too, have to know those around them
    spans = rows.select("path", "__span").distinct().join(marks, ["path", "__span"], "left")
    by = Window.partitionBy("path").orderBy("__span")
    before = F.last("last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    spans = spans.select("path", "__span", before.alias("__before"), after["mark"].alias("__after"))
    own = Window.partitionBy("path", "__span").orderBy("offset")
    rows = rows.withColumn("__last", F.last("__told", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("__next", F.first("__told", ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))["mark"])
    rows = rows.join(spans, ["path", "__span"]).withColumn("__state", F.coalesce("__last", "__before"))
    # no marker stands between a begin and the records of its block, so what follows them follows it
    inside = F.col("__told").isNull() & (F.col("__state.mark") == "b") & (F.coalesce("__next", "__after") == "e")
    made = {"block": F.when(inside, F.col("__state.at"))} | {k: F.when(inside, F.col("__state")[k]) for k in carry}
    return rows.withColumns(made).select(*records.columns, *made)


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return top_n_per_group(df, key, order, 1, "__rank").drop("__rank")


def timeline(changes: DataFrame, n: int) -> DataFrame:
    """The newest n changes of every entity, newest first."""
    return top_n_per_group(changes, ["entity_type", "entity_id"], [F.desc("changed_at"), F.desc("change_id")], n)


def version_changes(versions: DataFrame, columns: list[str], order: str = "version") -> DataFrame:
    """Each version with the one before and which columns changed (versions are few: one row a release)."""
    w = Window.orderBy(order)
    before = {f"old_{c}": F.lag(c).over(w) for c in columns}
    changed = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(c)) for c in columns)))
    return versions.withColumns({"previous": F.lag(order).over(w)} | before).withColumn("changed", changed).drop(*before)


def mark_current(versions: DataFrame, order: str = "version") -> DataFrame:
    """Exactly one row is current: the last; a single aggregate finds it."""
    last = versions.agg(F.max(order).alias("__last"))
    return versions.crossJoin(F.broadcast(last)).withColumn("is_current", F.col(order) == F.col("__last")).drop("__last")


def section_bounds(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, number, start, length) of the sections that begin at each match of a pattern; 1-based starts.

    The text is split in front of the matches, so that positions are sums of lengths and no row is joined.
    """
    pieces = F.split(text, f"(?={pattern})")
    rows = texts.select(key, F.posexplode(pieces).alias("number", "piece"))
    w = Window.partitionBy(key).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)) + 1).withColumn("length", F.length("piece"))
    return rows.where(F.col("piece").rlike(f"^(?:{pattern})")).select(key, "number", "start", "length")
