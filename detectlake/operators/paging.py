"""Pages, previews and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import sent


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a total order, with total and pages on each row.

    The total is a separate aggregate of one row. Deep pages sort as many rows as they skip: use
    ``keyset_page`` for those.
    """
    if number < 1 or size < 1:
        raise ValueError("pages count from 1 and hold 1 row at least")
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next rows after a key tuple in ascending order; no row before it is sorted."""
    if after is not None:
        df = df.where(F.struct(*keys) > F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, after, strict=True))))
    return df.orderBy(*keys).limit(size)


def preview(runs: Column, most: int = 200) -> Column:
    """Runs joined by ' | ', cut with three dots."""
    joined = F.array_join(runs, " | ")
    return F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most), F.lit("..."))).otherwise(joined)


def match_snippet(text: Column, q: str, around: int = 30) -> Column:
    """The first hit in any case with some text around it; null without one."""
    at = F.locate(q.lower(), F.lower(text))
    start, end = F.greatest(at - around, F.lit(1)), F.least(at + len(q) - 1 + around, F.length(text))
    cut = F.substr(text, start, end - start + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(end < F.length(text), "...").otherwise("")))


def top_strings(runs: Column, n: int = 50, most: int = 100) -> Column:
    return F.transform(F.slice(runs, 1, n), lambda s: F.substring(s, 1, most))


def top_counts(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value (a top-k operator in the plan, not a sort)."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(k)


def family_page(entities: DataFrame, q: str | None, category: str | None, number: int, size: int) -> DataFrame:
    """Families by count, paginated over groups."""
    from .filters import eq_filter, icontains

    rows = eq_filter(entities, category=category)
    rows = rows.where(icontains("family", q)) if q else rows
    return page(rows.groupBy("family").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("family")], number, size)


def latest(df: DataFrame, at: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(key)).limit(n)


def priority_batch(df: DataFrame, pending: Column, flag: str, key: str, n: int) -> DataFrame:
    return df.where(pending).orderBy(F.desc(flag), key).limit(n)


def array_page(column: str, offset: int, limit: int) -> dict[str, Column]:
    """A slice of an array column and its whole length; null counts as empty."""
    return {"part": F.coalesce(F.slice(column, offset + 1, limit), F.array().cast("array<string>")), "total": F.coalesce(F.size(column), F.lit(0))}


def ordered_by_selection(df: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Rows in the order of the first mention of their key in a list the caller gives."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], f"{key} long, position int")
    return df.join(sent(wanted, len(set(ids))), key).orderBy("position")


def detail(entities: DataFrame, items: DataFrame, key: int, most: int = 20) -> DataFrame:
    """One entity with its number of items and its first items nested, by their order."""
    own = items.where(F.col("owner") == key)
    first = own.withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy("ord"))).where(F.col("rank") <= most)
    nested = first.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("ord", "sig_type", "size"))).alias("items"))
    counts = own.groupBy("owner").agg(F.count(F.lit(1)).alias("n_items"))
    out = entities.where(F.col("signature_id") == key).withColumnRenamed("signature_id", "owner")
    return out.join(counts, "owner", "left").join(nested, "owner", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
