"""Pages by number over an order-statistic index (P1, P9): a page far down reads the ranges that it lies in, and no others."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class PageIndex:
    """Rows in ranges of their order, a folder each, and the number of rows before each range."""

    spark: SparkSession
    folder: str
    order: tuple[Column, ...]
    #: Rows in all ranges before each, and in all of them.
    before: tuple[int, ...]
    total: int
    schema: T.StructType

    @staticmethod
    def build(df: DataFrame, order: list[Column], folder: str, ranges: int) -> PageIndex:
        """Sort rows into ``ranges`` ranges of about equal size; ``order`` has to tell all rows apart."""
        spark = df.sparkSession
        df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()).sortWithinPartitions(*order).write.partitionBy("__range").parquet(folder)
        kept = T.StructType([*df.schema.fields, T.StructField("__range", T.IntegerType())])
        found = spark.read.schema(kept).parquet(folder).groupBy("__range").count().collect()  # a row a range, from the files' footers
        counts = [0] * ranges
        for r in found:
            counts[r["__range"]] = r["count"]
        return PageIndex(spark, folder, tuple(order), (0, *accumulate(counts[:-1])), sum(counts), df.schema)

    def ranges_of(self, first: int, last: int) -> list[int]:
        """Numbers of the ranges that hold rows from place ``first`` to before ``last``, both from 0."""
        last = min(last, self.total)
        if first >= last:
            return []
        low, high = (bisect_right(self.before, at) - 1 for at in (first, last - 1))
        ends = (*self.before[1:], self.total)
        return [r for r in range(low, high + 1) if self.before[r] < ends[r]]

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of a page (from 1) with their ``position`` (from 0); none behind the last page."""
        first = (number - 1) * size
        ranges = self.ranges_of(first, first + size)
        if not ranges:
            return self.spark.createDataFrame([], self.schema).withColumn("position", F.lit(0).cast("long"))
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/__range={r}" for r in ranges))
        skip = first - self.before[ranges[0]]
        # as many rows as a page are sorted last; those before it in its ranges are passed by a top-k
        page = rows.orderBy(*self.order).limit(skip + size).offset(skip)
        numbered = page.select(F.struct(*rows.columns).alias("row")).agg(F.collect_list("row").alias("rows"))
        return numbered.select(F.posexplode("rows").alias("at", "row")).select("row.*", (F.col("at") + first).cast("long").alias("position"))
