"""Readers (S1-S6): typed tables, record containers, scripts, listings and inventories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_catalog(spark: SparkSession, path: str, tables: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Parquet tables of a folder by name, with the given schemas."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in tables.items()}


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in ranges of its key, one a partition."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def records_of(data: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    """(type, size, payload, offset) of length-prefixed records: a byte of type, a low byte and 16 high bits of size.

    Ends at the first record that would overrun the data.
    """
    at = 0
    while at + 4 <= len(data):
        size = data[at + 1] | int.from_bytes(data[at + 2 : at + 4], "little") << 8
        if at + 4 + size > len(data):
            return
        yield data[at], size, data[at + 4 : at + 4 + size], at
        at += 4 + size


def explode_records(files: DataFrame) -> DataFrame:
    """Records of containers (path, content); a container is one row and so one task's work, written on at once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows: list[tuple] = []
                for record in records_of(bytes(content)):
                    rows.append((path, *record))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=schemas.RECORD.names)
                        rows = []
                yield pd.DataFrame(rows, columns=schemas.RECORD.names)

    return files.select("path", "content").mapInPandas(read, schemas.RECORD)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    return explode_records(spark.read.format("binaryFile").load(folder))


def read_scripts(spark: SparkSession, folder: str, most: int = 100_000) -> DataFrame:
    """(path, source, content_hash): cleaned of three control characters; hashed whole, stored up to ``most`` characters."""
    raw = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("source"))
    return clean_scripts(raw, most)


def clean_scripts(raw: DataFrame, most: int = 100_000) -> DataFrame:
    """Blank sources go; the hash is that of the whole cleaned source."""
    whole = F.translate("source", "\x00\x13\x0f", "")
    kept = raw.withColumn("source", whole).where(F.col("source").rlike(r"\S"))
    return kept.withColumn("content_hash", F.sha2("source", 256)).withColumn("source", F.substring("source", 1, most))


def read_entity_listing(spark: SparkSession, folder: str, name: str = "combined.sig") -> DataFrame:
    """Entities from category/family/combined.sig texts.

    Spark's readers skip file names that begin with an underscore: rename such listings when they are put
    in place, or read them by other means and give them to ``entity_listing``.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(folder, wholetext=True)
    return entity_listing(raw.select(F.input_file_name().alias("path"), "value"))


def entity_listing(raw: DataFrame) -> DataFrame:
    """Entities from listings (path, value); category and family are the last two folders of the path.

    A missing id becomes a hash of category and family, and a missing name both of them.
    """
    parts = F.split("path", "/")
    named = raw.select("value", F.element_at(parts, -3).alias("category"), F.element_at(parts, -2).alias("family"))
    field = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return named.select(
        F.coalesce(field(r"(?i)threat id:\s*(\d+)").cast("long"), F.xxhash64("category", "family")).alias("signature_id"),
        F.coalesce(field(r"(?i)threat name:\s*([^\n]+)"), F.concat_ws("/", "category", "family")).alias("threat_name"),
        "category",
        "family",
        F.coalesce(field(r"(?i)signatures?:\s*(\d+)").cast("int"), F.lit(0)).alias("signature_count"),
    )


def read_record_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records written by ``write_record_csv``; is_lua is the text true in any case.

    A cell without anything is null and a quoted empty one an empty text, which Spark tells apart only where
    nulls are given a name of their own. Quoted cells may hold line ends.
    """
    raw = spark.read.schema(schemas.RECORD_CSV).csv(path, header=True, quote='"', escape='"', nullValue="\u0000null", multiLine=True)
    return raw.withColumn("is_lua", F.coalesce(F.lower("is_lua") == "true", F.lit(False)))


def list_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Files with size and time, and how many lie in each folder; contents aren't read, and files without any are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    files = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    counts = files.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    return files.join(counts, "folder")
