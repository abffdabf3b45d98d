"""State with an end (R5): periods of activity by entity, kept until event time has passed them (session windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where state lies that may outgrow memory.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(periods: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Periods (first, last, number) in order, joined where no more than a gap lies between them: what ``ended_periods`` is held to."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(periods):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def ended_periods(changes: DataFrame, gap_seconds: int, late: str = "1 day") -> DataFrame:
    """(entity_type, entity_id, first_at, last_at, n): periods of changes that lie no more than a gap apart, once they have ended.

    A period has ended when the watermark, ``late`` behind the newest change and cut to milliseconds, is more
    than a gap behind its last change; its state then goes, so that state holds entities with open periods
    only. A row is dropped once the watermark is more than a gap behind it. Entities with a null type or id
    count like others; rows without a time have no period. Runs in append mode; the state of very many
    entities belongs on disk, as in ``use_timers``.
    """
    # Spark ends a session when the watermark reaches its end: a millisecond later it is behind it
    rows = changes.where(F.col("changed_at").isNotNull()).withWatermark("changed_at", f"{late} 1 millisecond")
    period = F.session_window("changed_at", f"{gap_seconds} seconds")
    found = rows.groupBy("entity_type", "entity_id", period).agg(F.min("changed_at").alias("first_at"), F.max("changed_at").alias("last_at"), F.count(F.lit(1)).alias("n"))
    return found.select("entity_type", "entity_id", "first_at", "last_at", "n")


class use_timers:  # noqa: N801  a context manager
    """Streams started inside keep their state in RocksDB, out of a task's memory; the setting is put back at the end."""

    def __init__(self, spark):  # noqa: ANN001
        self.spark, self.key = spark, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.key, None)
        self.spark.conf.set(self.key, ROCKS)

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.spark.conf.unset(self.key)
        else:
            self.spark.conf.set(self.key, self.before)
