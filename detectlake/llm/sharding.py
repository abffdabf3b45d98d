"""Sharding by jump consistent hashing.

A stable key goes to a shard by arithmetic alone: there is no ring table to hold or to send. When a shard
is appended, the only rows that move are those that the new shard takes, one in ``shards + 1``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64, table


def jump_shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of uint64 keys (Lamping and Veach, 2014), over whole arrays.

    Each round draws the next shard count at which a key would move; keys that would move beyond ``shards``
    are done. A round moves a key on by one shard at least, so there are at most ``shards`` rounds.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state, at = keys.astype(np.uint64).copy(), np.full(len(keys), -1, np.int64)
    ahead, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = np.floor((at[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard, from 0, of a long key; a null key counts as -1."""

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_shards(mix64(k.to_numpy(np.int64).astype(np.uint64)), shards).astype(np.int32))

    return shard(F.coalesce(key.cast("long"), F.lit(-1)))


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", slots_by: int = 4_096, run: int = 10_000) -> DataFrame:
    """Shard, and a gapless slot in the shard, for each row.

    Returns key, size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null text counts as empty), law
    (``key``), shard, slot and grown_shard (with one more shard). The key and the shard count alone decide
    the shard, also of a null key. Rows that are equal in all of this are counted, and runs of at most ``run``
    of them are dealt to the ``slots_by`` parts of the shard and numbered there, so that no row, however
    often repeated, gathers in one task. Slots follow the hash of the rows, so equal input gives equal
    slots; other columns of ``docs`` aren't read. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("all"))
    runs = counted.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1, F.lit(run).cast("long"))))
    placed = runs.withColumn("n", F.least(F.col("all") - F.col("at"), F.lit(run))).withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)})
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "at"), F.lit(slots_by)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # shards * slots_by rows at most, whatever the input
    offsets = placed.groupBy("shard", "part").agg(F.sum("n").alias("rows")).select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32", "at").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0))
    runs = placed.join(F.broadcast(offsets), ["shard", "part"]).withColumn("first", first)
    return runs.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"), "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=8)
