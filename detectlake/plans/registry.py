"""The registry of queries: each applies an operator to the tables of a folder, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bind import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Catalog], DataFrame]], Callable[[Catalog], DataFrame]]:
    """Register a function of a catalog under a name, with the DuckDB SQL of the same rows."""

    def register(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Catalog(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return register
