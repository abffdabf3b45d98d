"""Stored sketches of distinct values by day and kind (A1, A12, A21): counts over ranges without another scan of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Log2 of a sketch's registers: its standard error is about 0.8 percent.
REGISTERS = 14
#: What an estimate may be off, as a share: more than three standard errors.
ERROR = 0.03


def daily(rows: DataFrame, day: str, kind: str, value: str) -> DataFrame:
    """(day, kind, rows, sketch): as many rows as days have kinds, whatever the number of values; null values aren't counted as values.

    Sketches of one day and kind may come from several loads: whatever reads them merges them.
    """
    made = F.hll_sketch_agg(F.col(value), F.lit(REGISTERS))
    return rows.groupBy(F.col(day).alias("day"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("rows"), made.alias("sketch"))


def store(sketches: DataFrame, folder: str) -> None:
    """Write sketches sorted by day, so that ranges of days read their own row groups; a load that is repeated replaces itself."""
    sketches.repartitionByRange("day").sortWithinPartitions("day", "kind").write.mode("overwrite").parquet(folder)


def between(table: DataFrame, ranges: DataFrame) -> DataFrame:
    """(kind, since, until, rows, estimate) for each range of days (since, until), the latter outside.

    ``ranges`` is a caller's short list. Estimates are within ERROR of the exact number of distinct values,
    but for about one in a thousand; ranges without rows give none.
    """
    met = table.join(F.broadcast(ranges), (F.col("day") >= F.col("since")) & (F.col("day") < F.col("until")))
    return met.groupBy("kind", "since", "until").agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
