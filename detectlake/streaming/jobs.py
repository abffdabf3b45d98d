"""Streaming jobs (R1-R8); each works on any streaming DataFrame of the schema it reads."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.delta import field_diff, snapshot_delta
from ..operators.windows import last_wins
from ..scratch import children, materialise, new_folder
from .snapshots import Snapshot


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 1_000, form: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", per_trigger).load(folder)


def by_epoch(folder: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own; a batch that is repeated after a failure replaces what it had written."""
    return lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/{epoch}")


def newest(spark: SparkSession, folder: str, before: int | None = None) -> str | None:
    """The folder of the last batch that was written, or of the last one before a batch."""
    done = [int(n) for n in children(spark, folder) if n.isdigit() and (before is None or int(n) < before)]
    return f"{folder}/{max(done)}" if done else None


def incremental_ingest(stream: DataFrame, checkpoint: str, known: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], key: str = "version") -> StreamingQuery:
    """Work off what has arrived and stop; rows of versions already known are skipped.

    ``apply`` may see a batch again after a failure and must write it by its number (see ``by_epoch``).
    """

    def batch(df: DataFrame, epoch: int) -> None:
        apply(df.join(known().select(key).distinct(), key, "left_anti"), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_feed(stream: DataFrame, folder: str, first: DataFrame, columns: list[str], key: str, order: str, deleted: str) -> StreamingQuery:
    """Bring a snapshot up to date batch by batch, and keep what really changed, before and after (R2).

    Stream rows have the key, the columns, ``order`` (the last row of a key counts, in a batch) and whether
    the key is ``deleted``. ``folder``/snapshot is a ``Snapshot`` with the state after each batch, of which a
    batch writes what it changes; ``folder``/changes/N holds batch N's changes (added, updated, removed, with
    diff and summary); nothing tracked changed: no row. Batch N reads the state before it, of its own keys
    only, and replaces what it had written, so that a repeated batch does no harm.
    """
    spark = stream.sparkSession
    schema = first.select(key, *columns).schema
    state = Snapshot(spark, f"{folder}/snapshot", schema, key)
    state.start(first)

    def batch(df: DataFrame, epoch: int) -> None:
        # dealt by key first: otherwise each task would sort the whole file that it reads
        last = materialise(last_wins(df.repartition(key), [key], [F.desc(order), F.desc(F.xxhash64(*columns))]), "last")
        old, new = state.read(epoch, last), last.where(~F.col(deleted)).select(key, *columns)
        delta = snapshot_delta(old, new, key, columns).where(F.col("change") != "same")
        by_epoch(f"{folder}/changes")(delta.withColumns(field_diff("before", "after", columns)).withColumn("epoch", F.lit(epoch)), epoch)
        told = spark.read.parquet(f"{folder}/changes/{epoch}")
        now = [F.when(F.col("change") == "removed", F.col(f"before.{c}")).otherwise(F.col(f"after.{c}")).alias(c) for c in columns]
        state.apply(told.select(key, *now, (F.col("change") == "removed").alias("deleted")), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def daily_counts(changes: DataFrame, at: str = "changed_at", late: str | None = "1 day") -> DataFrame:
    """Changes by UTC day (R3); with ``late``, rows later than that are dropped and counted in the query's progress.

    Without it all rows count, whatever order they come in, and the state has a row a day.
    """
    marked = changes if late is None else changes.withWatermark(at, late)
    days = marked.groupBy(F.window(at, "1 day"))
    return days.agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "n")


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks drop, batch by batch, for as long as a query runs.

    A query's own progress reports go back a hundred batches only.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.dropped, self.batches = spark, Counter(), Counter()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        progress = event.progress
        self.batches[str(progress.id)] += 1
        self.dropped[str(progress.id)] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def of(self, query: StreamingQuery) -> int:
        """Rows of a query that were dropped so far, in all batches since the listener was added."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        return self.dropped[str(query.id)]


def entity_state(changes: DataFrame) -> DataFrame:
    """First and last change and their number for each entity, for update or complete output."""
    return changes.groupBy("entity_type", "entity_id").agg(F.min("changed_at").alias("first_at"), F.max("changed_at").alias("last_at"), F.count(F.lit(1)).alias("n"))


def distinct_scripts(scripts: DataFrame, at: str, keep: str = "7 days") -> DataFrame:
    """One row a content hash within the watermark, so that state doesn't grow for ever."""
    return scripts.withWatermark(at, keep).dropDuplicatesWithinWatermark(["content_hash"])


def enriched(scripts: DataFrame, names: Column, rules: DataFrame, **own: Column) -> DataFrame:
    """Scripts with columns worked out of their source, and the rules they name: a stateless map and a static join.

    ``names`` is the array of names in a script; ``rules`` has (name, rule). A script gives a row for each of
    its distinct names, or one without a name; names that no rule has stay, without one.
    """
    rows = scripts.withColumns(own).withColumn("name", F.explode_outer(F.array_distinct(names)))
    return rows.join(rules.select("name", "rule"), "name", "left")


def publish_unchanged(stream: DataFrame, folder: str, inputs: Callable[[], DataFrame], pending: str = "pending") -> StreamingQuery:
    """Publish results (id, content_hash, ...) whose input still has the hash and status they were made from.

    Inputs are read anew for every batch, and the check is part of the batch's write. ``folder``/published is
    a ``Snapshot`` by id: a batch writes the rows that it publishes, and ``published`` reads the outcome.
    """
    rows = T.StructType([f for f in stream.schema.fields])
    state = Snapshot(stream.sparkSession, f"{folder}/published", rows, "id")

    def batch(df: DataFrame, epoch: int) -> None:
        now = inputs().where(F.col("status") == pending).select("id", "content_hash")
        good = last_wins(df.join(now, ["id", "content_hash"], "left_semi"), ["id"], [F.desc("content_hash"), F.desc(F.xxhash64(*rows.names))])
        state.apply(good.withColumn("deleted", F.lit(False)), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The last published row of each id; a later batch replaces what an earlier one had. Fails if nothing was ever run."""
    return Snapshot.open(spark, f"{folder}/published").read()


def run_to_files(stream: DataFrame, mode: str, keys: list[str] | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Run a stream over all that is there, however long it takes, and read its result from Parquet.

    Batches go to folders by number in the folder that driver and executors share, so that one that is
    repeated replaces itself. In ``append`` mode all batches make the result; in ``update`` mode the last row
    of each key does, and no batch writes more than what it changed.
    """
    spark = stream.sparkSession
    folder = new_folder(spark)
    write = by_epoch(f"{folder}/out")
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: write(df.withColumn("epoch", F.lit(epoch)), epoch)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if newest(spark, f"{folder}/out") is None:
        return spark.createDataFrame([], stream.schema), query
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return (last_wins(rows, keys, [F.desc("epoch")]) if keys else rows).drop("epoch"), query
