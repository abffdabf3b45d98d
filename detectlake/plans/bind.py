"""Catalog roles played by plain analytics tables, as DataFrames and as DuckDB views of the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Catalog:
    """Lazily read roles of one folder of tables."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def entity(self) -> DataFrame:
        family = F.expr("replace(p_brand, '#', '')")
        return self.read("part").select(
            F.col("p_partkey").alias("signature_id"),
            F.concat("p_type", F.lit(":"), family, F.lit("/"), F.expr("replace(p_name, ' ', '.')")).alias("threat_name"),
            F.col("p_type").alias("category"),
            family.alias("family"),
            F.col("p_size").alias("signature_count"),
        )

    @property
    def item(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_partkey").alias("owner"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
            F.col("l_linenumber").alias("sig_type"),
            F.concat("l_returnflag", "l_linestatus").alias("sig_type_name"),
            F.col("l_quantity").cast("int").alias("size"),
            F.col("l_returnflag").alias("category"),
            F.col("l_linestatus").alias("subcategory"),
        )

    @property
    def payload(self) -> DataFrame:
        """Items with bytes; owners are dealt over 97 entities."""
        return self.read("documents").select(
            F.col("doc_id").alias("id"),
            F.pmod("doc_id", F.lit(97)).alias("owner"),
            F.sha2(F.encode("text", "UTF-8"), 256).alias("data_hash"),
            F.octet_length("text").alias("size"),
            F.col("lang").alias("category"),
            F.col("source").alias("sig_type_name"),
            F.col("text"),
            F.encode("text", "UTF-8").alias("data"),
        )

    @property
    def script(self) -> DataFrame:
        return self.read("pages").select(F.col("page_id").alias("id"), F.col("html").alias("source"), F.sha2("html", 256).alias("content_hash"))

    @property
    def rule_row(self) -> DataFrame:
        """Values of rules as they occur, with repeats."""
        values = self.read("lineitem").join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        return values.select(F.col("l_suppkey").alias("guid"), F.lower("p_name").alias("value"), F.col("p_type").alias("field"))

    @property
    def rule_value(self) -> DataFrame:
        return self.rule_row.distinct()

    def rule_code(self, of: Callable[[Column, Column], Column]) -> DataFrame:
        """(guid, value): ``rule_row`` with a number for each field and value, which is worked out on parts before these meet lines."""
        parts = self.read("part").select("p_partkey", of(F.col("p_type"), F.lower("p_name")).alias("value"))
        return self.read("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("guid"), "value")

    @property
    def change(self) -> DataFrame:
        return self.read("events").select(F.col("event_id").alias("change_id"), F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("change_type"), F.col("ts").cast("timestamp").alias("changed_at"), "value", F.col("props").alias("payload"))

    @property
    def snapshot_old(self) -> DataFrame:
        return self.read("orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))

    @property
    def snapshot_new(self) -> DataFrame:
        changed = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
        return self.read("orders").where("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("key"), changed.alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))

    @property
    def version(self) -> DataFrame:
        """One row a quarter: its orders stand for the files of a version."""
        named = self.read("orders").select(F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("version"), "o_orderkey", "o_custkey")
        return named.groupBy("version").agg(F.count(F.lit(1)).alias("files"), F.sum("o_orderkey").alias("key_sum"), F.countDistinct("o_custkey").alias("owners"))


#: The same roles for DuckDB.
VIEWS = {
    "entity": "SELECT p_partkey AS signature_id, p_type || ':' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '.') AS threat_name, p_type AS category, replace(p_brand, '#', '') AS family, p_size AS signature_count FROM part",
    "item": "SELECT l_partkey AS owner, l_orderkey * 10 + l_linenumber AS ord, l_linenumber AS sig_type, l_returnflag || l_linestatus AS sig_type_name, CAST(trunc(l_quantity) AS INTEGER) AS size, l_returnflag AS category, l_linestatus AS subcategory FROM lineitem",
    "payload": "SELECT doc_id AS id, doc_id % 97 AS owner, sha256(text) AS data_hash, strlen(text) AS size, lang AS category, source AS sig_type_name, text FROM documents",
    "script": "SELECT page_id AS id, html AS source, sha256(html) AS content_hash FROM pages",
    "rule_value": "SELECT DISTINCT l_suppkey AS guid, lower(p_name) AS value, p_type AS field FROM lineitem JOIN part ON l_partkey = p_partkey",
    "change": "SELECT event_id AS change_id, event_type AS entity_type, user_id AS entity_id, event_type AS change_type, ts AS changed_at, value, props AS payload FROM events",
    "snapshot_old": "SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 10 <> 0",
    "snapshot_new": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 10 <> 1",
    "version": "SELECT CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS version, count(*) AS files, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, count(DISTINCT o_custkey) AS owners FROM orders GROUP BY 1",
}


def over(*roles: str, sql: str) -> str:
    """SQL with the named roles in front as common table expressions."""
    return "WITH " + ", ".join(f"{r} AS ({VIEWS[r]})" for r in roles) + " " + sql
