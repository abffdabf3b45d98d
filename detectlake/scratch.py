"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"{tempfile.gettempdir()}/detectlake-checkpoints"


def new_folder(spark: SparkSession) -> str:
    """The path of a new folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/detectlake-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: what is read several times is worked out once, and lost executors don't matter."""
    path = f"{new_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a caller's list up to which it goes to all tasks.
MOST_SENT = 100_000


def sent(rows: DataFrame, n: int) -> DataFrame:
    """A caller's list of n narrow rows, marked to be broadcast if it is short; a longer one is joined by a shuffle."""
    return F.broadcast(rows) if n <= MOST_SENT else rows


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
