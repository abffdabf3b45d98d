"""Snapshots that are kept as a log (R2, R8, J16): a base in hash buckets, changes by epoch, and a manifest an epoch.

An epoch writes as much as it changes. The manifest of an epoch names the base and the changes that make up
the state after it; it appears at once, by renaming, so that readers see whole epochs only. An epoch that is
repeated starts from the manifest before it and replaces its own files. After a number of epochs their
changes become part of a new base.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import last_wins
from ..scratch import children


@dataclass(frozen=True)
class Manifest:
    """The state after an epoch: the folder of a base (if any), and of the changes after it, oldest first."""

    epoch: int
    base: str | None
    deltas: tuple[str, ...]


@dataclass(frozen=True)
class Snapshot:
    """Rows by key under a folder. Keys are unique and not null; each change is a row or a deletion of a key."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    key: str
    buckets: int = 16
    #: Epochs whose changes are read beside the base; with one more they become part of a new one.
    most_deltas: int = 8

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Snapshot | None:
        """The snapshot that a folder holds, if there is one."""
        epochs = Snapshot._epochs(spark, folder)
        if not epochs:
            return None
        told = json.loads(spark.read.text(f"{folder}/manifest/{max(epochs)}.json", wholetext=True).first()[0])
        return Snapshot(spark, folder, T.StructType.fromJson(told["schema"]), told["key"], told["buckets"], told["most_deltas"])

    @staticmethod
    def _epochs(spark: SparkSession, folder: str) -> list[int]:
        return [int(n.removesuffix(".json")) for n in children(spark, f"{folder}/manifest") if n.endswith(".json")]

    def _path(self, name: str):  # noqa: ANN202  a Hadoop path and its file system
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self, before: int | None = None) -> Manifest | None:
        """The newest manifest, or the newest one of the epochs before one."""
        epochs = [e for e in self._epochs(self.spark, self.folder) if before is None or e < before]
        if not epochs:
            return None
        told = json.loads(self.spark.read.text(f"{self.folder}/manifest/{max(epochs)}.json", wholetext=True).first()[0])
        return Manifest(told["epoch"], told["base"], tuple(told["deltas"]))

    def _commit(self, made: Manifest) -> None:
        told = {"epoch": made.epoch, "base": made.base, "deltas": made.deltas, "schema": self.schema.jsonValue(), "key": self.key, "buckets": self.buckets, "most_deltas": self.most_deltas}
        draft, files = self._path(f"manifest/.{made.epoch}.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        place, _ = self._path(f"manifest/{made.epoch}.json")
        files.delete(place, False)  # of the same epoch, done before: it says the same
        if not files.rename(draft, place):
            raise OSError(f"{place} could not be written")
        self._forget(made)

    def _forget(self, newest: Manifest) -> None:
        """Delete what neither the newest manifest nor the one before it names; a repeated epoch needs that one."""
        before = self.manifest(newest.epoch)
        live = {x for m in (newest, before) if m for x in (m.base, *m.deltas)}
        kept = {m.epoch for m in (newest, before) if m}
        gone = [f"manifest/{e}.json" for e in self._epochs(self.spark, self.folder) if e not in kept and e < newest.epoch]
        for kind in ("base", "delta"):
            gone += [f"{kind}/{n}" for n in children(self.spark, f"{self.folder}/{kind}") if f"{kind}/{n}" not in live and int(n) < newest.epoch]
        for name in gone:
            place, files = self._path(name)
            files.delete(place, True)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, name: str) -> None:
        # a bucket's rows are one task's unless they are many: adaptive execution splits those
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def _stored(self, name: str, buckets: list[int] | None) -> DataFrame:
        kind = T.StructType([*self.schema.fields, T.StructField("deleted", T.BooleanType()), T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(kind).parquet(f"{self.folder}/{name}")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def start(self, rows: DataFrame, epoch: int = -1) -> None:
        """The first state, if there is none yet."""
        if self.manifest() is None:
            self._write(rows.select(*self.schema.names).withColumn("deleted", F.lit(False)), f"base/{epoch}")
            self._commit(Manifest(epoch, f"base/{epoch}", ()))

    def apply(self, changes: DataFrame, epoch: int) -> None:
        """Bring the state of the epoch before up to date: rows of the schema and ``deleted``; the keys are unique."""
        before = self.manifest(epoch) or Manifest(epoch, None, ())
        self._write(changes.select(*self.schema.names, F.coalesce("deleted", F.lit(False)).alias("deleted")), f"delta/{epoch}")
        made = Manifest(epoch, before.base, (*before.deltas, f"delta/{epoch}"))
        if len(made.deltas) > self.most_deltas:
            self._write(self._state(made, None).withColumn("deleted", F.lit(False)), f"base/{epoch}")
            made = Manifest(epoch, f"base/{epoch}", ())
        self._commit(made)

    def _state(self, of: Manifest, buckets: list[int] | None) -> DataFrame:
        names = self.schema.names
        base = None if of.base is None else self._stored(of.base, buckets).select(*names)
        if not of.deltas:
            return base if base is not None else self.spark.createDataFrame([], self.schema)
        told = None
        for at, name in enumerate(of.deltas):
            rows = self._stored(name, buckets).select(*names, "deleted", F.lit(at).alias("__at"))
            told = rows if told is None else told.unionByName(rows)
        newest = last_wins(told, [self.key], [F.desc("__at")])
        now = newest.where(~F.col("deleted")).select(*names)
        return now if base is None else base.join(told.select(self.key).distinct(), self.key, "left_anti").select(*names).unionByName(now)

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The state, or the one before an epoch; of some keys only, if given: then only the buckets that they are in are read."""
        of = self.manifest(before)
        if of is None:
            return self.spark.createDataFrame([], self.schema)
        if keys is None:
            return self._state(of, None)
        wanted = keys.select(self.key).distinct()
        asked = [r.bucket for r in wanted.select(self._bucket()).distinct().collect()]  # no more than there are buckets
        return self._state(of, asked if len(asked) < self.buckets else None).join(wanted, self.key, "left_semi")
