"""Versions of a catalog: differences, upserts and the change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_delta(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, before, after): added, removed, updated or same, by one full outer join on the key."""
    x = old.select(F.col(key), F.struct(*columns).alias("before"))
    y = new.select(F.col(key), F.struct(*columns).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("updated")
    return x.join(y, key, "full_outer").select(key, change.alias("change"), "before", "after")


def field_diff(before: str, after: str, columns: list[str], most: int = 5, cut: int = 50) -> dict[str, Column]:
    """Changed fields as text, and a summary of the first ``most`` of them with how many more there are."""
    cell = lambda side, c: F.substring(F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("")), 1, cut)
    parts = [
        F.when(F.col(f"{before}.{c}").isNull() & F.col(f"{after}.{c}").isNotNull(), F.concat(F.lit(f"{c} added: "), cell(after, c)))
        .when(F.col(f"{before}.{c}").isNotNull() & F.col(f"{after}.{c}").isNull(), F.lit(f"{c} removed"))
        .when(~F.col(f"{before}.{c}").eqNullSafe(F.col(f"{after}.{c}")), F.concat(F.lit(f"{c}: "), cell(before, c), F.lit(" -> "), cell(after, c)))
        for c in columns
    ]
    diff = F.array_compact(F.array(*parts))
    more = F.when(F.size(diff) > most, F.concat(F.lit(" (+"), (F.size(diff) - most).cast("string"), F.lit(" more)"))).otherwise("")
    return {"diff": diff, "summary": F.concat(F.array_join(F.slice(diff, 1, most), "; "), more)}


def history_payload(columns: list[str], large: list[str]) -> Column:
    """The struct that history keeps: large values as the md5 of their JSON."""
    return F.struct(*(F.col(c) for c in columns if c not in large), *(F.md5(F.to_json(F.struct(c))).alias(c) for c in large))


def changes_between(old: DataFrame, new: DataFrame, key: str, columns: list[str], version: str) -> DataFrame:
    """The change feed of one version: no row for what stayed the same."""
    delta = snapshot_delta(old, new, key, columns).where(F.col("change") != "same")
    return delta.withColumns(field_diff("before", "after", columns)).withColumn("version", F.lit(version))


def upsert(old: DataFrame, new: DataFrame, key: str, remove: DataFrame | None = None) -> DataFrame:
    """Rows of old that new doesn't replace, and new; keys in ``remove`` go. Written to a new folder, never over old."""
    kept = old.join(new.select(key), key, "left_anti").unionByName(new)
    return kept if remove is None else kept.join(remove.select(key), key, "left_anti")


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def cascade_delete(children: DataFrame, parent: str, removed: DataFrame, key: str) -> DataFrame:
    return children.join(removed.select(F.col(key).alias(parent)).distinct(), parent, "left_anti")


def missing_keys(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(df.select(key), key, "left_anti")


def version_fingerprint(parts: list[str]) -> Column:
    """A digest of the parts that are there, in fixed order."""
    return F.sha2(F.concat_ws("|", *(F.col(p).cast("string") for p in parts)), 256)


def run_totals(delta: DataFrame) -> DataFrame:
    return delta.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "updated", "same")))


def with_version(changes: DataFrame, versions: DataFrame, by: str, fallback: str) -> DataFrame:
    """Changes with the version they came with, or the value stored beside them if that version is gone."""
    known = versions.select(F.col("version").alias("__known"))
    out = changes.join(known, F.col(by) == F.col("__known"), "left")
    return out.withColumn("shown_version", F.coalesce("__known", fallback)).drop("__known")


def sync(old: DataFrame, new: DataFrame, key: str, columns: list[str], version: str, known: DataFrame, full: bool) -> dict[str, DataFrame]:
    """One version's work as lazy tables: snapshot, changes, totals and versions.

    Raises if new is empty, and returns nothing if the version is known. A full version replaces the
    snapshot; an incremental one only adds and updates. Of the versions, the new one is current.
    """
    if not known.where(F.col("version") == version).isEmpty():
        return {}
    if new.isEmpty():
        raise ValueError("a new version without rows isn't published")
    changes = changes_between(old, new, key, columns, version)
    if not full:
        changes = changes.where(F.col("change") != "removed")
    versions = known.select("version", F.lit(False).alias("is_current")).unionByName(old.sparkSession.createDataFrame([(version, True)], "version string, is_current boolean"))
    return {"snapshot": new if full else upsert(old, new, key), "changes": changes, "totals": run_totals(changes), "versions": versions}
