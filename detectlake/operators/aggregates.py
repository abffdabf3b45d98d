"""Counts and summaries."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def catalog_stats(tables: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """(table, rows, last_completed): rows of each table, and when the last of the completed runs (completed_at) ended."""
    counts = reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in sorted(tables.items())))
    last = runs.agg(F.max("completed_at").alias("last_completed"))
    return counts.withColumn("one", F.lit(1)).join(last.withColumn("one", F.lit(1)), "one").drop("one")


def category_counts(items: DataFrame, category: str = "category", subcategory: str = "subcategory") -> DataFrame:
    """Counts by category and subcategory with subtotals and total, in one scan; level counts the rolled-up columns."""
    return items.rollup(category, subcategory).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def type_label(name: Column, code: Column) -> Column:
    """The type's name, or UNKNOWN_0x and its code in two hex digits at least."""
    return F.coalesce(name, F.format_string("UNKNOWN_0x%02X", code))


def type_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(type_label(F.col("sig_type_name"), F.col("sig_type")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def guid_counts(scripts: DataFrame, rules: DataFrame, guids: str = "guids") -> DataFrame:
    """Scripts by rule, rules without scripts too; one pass whatever the number of rules."""
    used = scripts.select(F.explode(F.array_distinct(F.transform(guids, F.lower))).alias("guid")).groupBy("guid").agg(F.count(F.lit(1)).alias("n"))
    return rules.select(F.lower("guid").alias("guid")).distinct().join(used, "guid", "left").select("guid", F.coalesce("n", F.lit(0)).alias("scripts"))


def status_counts(df: DataFrame, status: str, flag: Column) -> DataFrame:
    return df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("flagged"))


def function_stats(functions: DataFrame) -> DataFrame:
    """Functions, mapped ones, entries and sorted names by category."""
    return functions.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("mapped_field").alias("mapped"), F.sum("entry_count").alias("entries"), F.array_sort(F.collect_set("name")).alias("names"))


def shared_values(values: DataFrame, least: int = 2, normal: Column | None = None) -> DataFrame:
    """(field, value, guid, rules) of values that at least ``least`` different rules list.

    Spellings of one value count once. Rules are counted before they are listed, and each is a row, so that
    a value that very many rules list isn't gathered.
    """
    normal = F.lower(F.trim(F.col("value"))) if normal is None else normal
    rows = values.select("field", normal.alias("value"), "guid").distinct()
    counts = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("rules")).where(F.col("rules") >= least)
    return rows.join(counts, ["field", "value"]).select("field", "value", "guid", "rules")


def merge_lists(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """The sorted union of list columns over all rows of a rule; each value is shuffled once."""
    rows = df.select(by, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("list")) for f in fields))).alias("x")).select(by, "x.field", F.explode("x.list").alias("value")).distinct()
    wide = rows.groupBy(by).agg(*(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.col("value")))).alias(f) for f in fields))
    return df.select(by).distinct().join(wide, by, "left").select(by, *(F.coalesce(f, F.array().cast("array<string>")).alias(f) for f in fields))


def daily_activity(changes: DataFrame, at: str = "changed_at", days: int | None = None, tracked_since: date | None = None, today: date | None = None) -> DataFrame:
    """(day, n): changes by UTC day with zeros for days without any; no rows if nothing was ever tracked.

    With ``today``, the last of ``days`` days (all, if None), but none before tracking began: on
    ``tracked_since``, or with the first change. Without it, from the first to the last change. Changes
    outside of these days don't count.
    """
    counted = changes.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n")).where(F.col("day").isNotNull())
    first, last = F.min("day"), F.max("day")
    if tracked_since is not None:
        first = F.lit(tracked_since)
    if today is not None:
        last = F.lit(today)
        first = F.greatest(first, F.date_sub(last, days - 1)) if days is not None else first
    span = counted.agg(F.count(F.lit(1)).alias("tracked"), first.alias("a"), last.alias("b")).where((F.col("tracked") > 0) & (F.col("a") <= F.col("b")))
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def heat_levels(daily: DataFrame, levels: int = 4) -> DataFrame:
    """Months with total, busiest day and a level from 0 to ``levels`` against the busiest month."""
    months = daily.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("n").alias("total"), F.max("n").alias("busiest"))
    top = F.max("total").over(Window.partitionBy())
    return months.withColumn("level", F.when(top > 0, F.ceil(F.col("total") * levels / top)).otherwise(0).cast("int"))


def group_signatures(items: DataFrame, top: int = 3) -> DataFrame:
    """Groups of (category, subcategory, type) with their count and their ``top`` most frequent sizes."""
    keys = ["category", "subcategory", "sig_type"]
    sizes = items.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("n"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "size")))
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "size", "n"))))
    return ranked.groupBy(*keys).agg(F.sum("n").alias("n"), F.transform(best, lambda x: x["size"]).alias("top_sizes"))


def cluster_label(family: Column, category: Column) -> Column:
    return F.coalesce(F.nullif(family, F.lit("")), F.nullif(category, F.lit("")), F.lit("Unknown"))


def coverage_stats(rules: DataFrame, fields: list[str]) -> DataFrame:
    size = reduce(Column.__add__, (F.coalesce(F.size(f), F.lit(0)) for f in fields))
    return rules.agg(F.count(F.lit(1)).alias("rules"), F.count_if(size > 0).alias("with_data"), F.sum(size).cast("long").alias("values"))


def string_profile(strings: DataFrame, by: str, string: str, kind: Column) -> DataFrame:
    """Distinct strings longer than 4 by class, for each entity; strings are shuffled as two hashes of 64 bits."""
    hashes = [F.xxhash64(F.col(string)).alias("h1"), F.xxhash64(F.lit(1), F.col(string)).alias("h2")]
    rows = strings.where(F.length(string) > 4).select(by, kind.alias("class"), *hashes).distinct()
    return rows.groupBy(by, "class").agg(F.count(F.lit(1)).alias("n"))


def risk_summary(rated: DataFrame, level: str = "level") -> DataFrame:
    """Rows at each level, zeros too, and the worst level that occurs."""
    from ..functions.risk import LEVELS, level_name, level_rank

    counts = [F.count_if(F.col(level) == x).alias(x) for x in LEVELS]
    return rated.agg(*counts, level_name(F.coalesce(F.max(level_rank(F.col(level))), F.lit(0))).alias("overall"))


def indicator_counts(indicators: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values and entities by kind; approximate counts keep a fixed-size sketch a kind."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return indicators.groupBy("kind").agg(count("value").alias("n_values"), count("owner").alias("n_owners"))


def size_statistics(items: DataFrame) -> DataFrame:
    return items.groupBy("sig_type_name").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("total_size"), F.min("size").alias("least"), F.max("size").alias("most"))


def pattern_sources(items: DataFrame) -> DataFrame:
    """(data_hash, owner, size, owners): the entities that hold each distinct pattern, a row each, and how many they are."""
    held = items.groupBy("data_hash", "owner").agg(F.min("size").alias("size"))
    counts = held.groupBy("data_hash").agg(F.count(F.lit(1)).alias("owners"))
    return held.join(counts, "data_hash")
