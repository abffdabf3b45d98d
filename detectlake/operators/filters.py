"""Predicates and filters (F1-F16): columns where a condition is enough, DataFrames where a table is changed."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FILTERS, LONGEST_VALUE = 20, 255
FIELDS = ("name", "category", "family", "signature_type")
OPERATIONS = ("contains", "not_contains", "equals", "starts_with", "ends_with")


def eq_filter(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns equal all given values; None leaves a column free (case matters)."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def icontains(column: Column | str, text: str) -> Column:
    """Contains the text, in any case; wildcards in it stand for themselves."""
    return text_predicate(column, "contains", text)


def text_predicate(column: Column | str, operation: str, value: str) -> Column:
    """One of OPERATIONS, without regard to case (also for equals); null counts as ''."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    column = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    text = re.sub(r"([\\%_])", r"\\\1", value)
    pattern = {"equals": text, "starts_with": f"{text}%", "ends_with": f"%{text}"}.get(operation, f"%{text}%")
    # ilike lower-cases both sides in the JVM; the pattern is a literal that the scan can see
    hit = column.ilike(pattern)
    return ~hit if operation == "not_contains" else hit


def parse_filters(raw: str | list[dict]) -> list[dict]:
    """Validate filters given as JSON or as dicts of field, op and value."""
    try:
        filters = json.loads(raw) if isinstance(raw, str) else raw
    except json.JSONDecodeError as e:
        raise ValueError(f"filters aren't JSON: {e}") from e
    if not isinstance(filters, list) or len(filters) > MOST_FILTERS:
        raise ValueError(f"filters must be a list of at most {MOST_FILTERS}")
    for f in filters:
        if not isinstance(f, dict) or set(f) != {"field", "op", "value"} or f["field"] not in FIELDS or f["op"] not in OPERATIONS:
            raise ValueError(f"not a filter: {f!r}")
        if not isinstance(f["value"], str) or not 1 <= len(f["value"].strip()) <= LONGEST_VALUE:
            raise ValueError(f"a value needs 1 to {LONGEST_VALUE} characters")
    return filters


def search_entities(entities: DataFrame, items: DataFrame, filters: str | list[dict] = (), q: str | None = None) -> DataFrame:
    """Entities that meet all filters and the query.

    Filters on fields of the entity make one condition. One on the item type asks for an item that has it
    (semi join); not_contains asks that no item contains it (anti join).
    """
    names = {"name": "threat_name", "category": "category", "family": "family"}
    conditions = [text_predicate(names[f["field"]], f["op"], f["value"].strip()) for f in parse_filters(list(filters) if not isinstance(filters, str) else filters) if f["field"] in names]
    if q:
        conditions.append(name_or_id("threat_name", "signature_id", q))
    out = entities.where(reduce(and_, conditions)) if conditions else entities
    for f in parse_filters(list(filters) if not isinstance(filters, str) else filters):
        if f["field"] == "signature_type":
            negative = f["op"] == "not_contains"
            hits = items.where(text_predicate("sig_type_name", "contains" if negative else f["op"], f["value"].strip())).select(F.col("owner").alias("signature_id"))
            out = out.join(hits, "signature_id", "left_anti" if negative else "left_semi")
    return out


def name_or_id(name: str, key: str, q: str) -> Column:
    """Name contains q, or the key is q read as a decimal or 0x number; numbers that no key can hold match none."""
    number = re.fullmatch(r"\s*(?:0[xX](?P<hex>[0-9a-fA-F]+)|\+?(?P<decimal>[0-9]+))\s*", q)
    if not number:
        return icontains(name, q)
    digits, base = (number["hex"], 16) if number["hex"] else (number["decimal"], 10)
    key_text = F.try_to_number(F.lit(digits), F.lit("9" * 38)).cast("decimal(38,0)") if base == 10 and len(digits) <= 38 else F.lit(int(digits, base) if int(digits, base) < 1 << 63 else None).cast("decimal(38,0)")
    return icontains(name, q) | F.coalesce(F.col(key).cast("decimal(38,0)") == key_text, F.lit(False))


def array_has(column: str, value: object) -> Column:
    return F.coalesce(F.array_contains(column, value), F.lit(False))


def array_presence(column: str, present: bool = True) -> Column:
    """Whether an array has elements; null and empty are alike."""
    some = F.size(F.coalesce(F.col(column), F.array().cast("array<string>"))) > 0
    return some if present else ~some


def tokens(*columns: str) -> Column:
    """Distinct lower-case words of the columns together."""
    joined = F.lower(F.concat_ws(" ", *columns))
    return F.array_distinct(F.filter(F.split(joined, "[^a-z0-9]+"), lambda t: t != ""))


def token_match(columns: tuple[str, ...], q: str) -> Column:
    """All words of the query occur as whole words (no stemming), or the first column contains the query."""
    words = sorted({w for w in re.split("[^a-z0-9]+", q.lower()) if w})
    every = reduce(and_, (F.array_contains(tokens(*columns), w) for w in words)) if words else F.lit(False)
    return every | icontains(columns[0], q)


def script_search(scripts: DataFrame, q: str) -> DataFrame:
    return scripts.where(icontains("source", q))


def global_search(parts: dict[str, tuple[DataFrame, str, str]], q: str, limit: int) -> DataFrame:
    """(kind, key, label, total) of at most ``limit`` hits of each kind, by key; parts give (table, key, text)."""
    from pyspark.sql import Window

    hits = [df.where(icontains(text, q)).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.substring(text, 1, 80).alias("label")) for kind, (df, key, text) in sorted(parts.items())]
    found = reduce(DataFrame.unionByName, hits)
    totals = found.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("key"))).where(F.col("n") <= limit).drop("n")
    return first.join(totals, "kind")


def rule_search(columns: tuple[str, ...], q: str) -> Column:
    return reduce(or_, (F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(q.lower()) for c in columns))


def time_range(column: str, start: str | None = None, end: str | None = None) -> Column:
    """Half-open [start, end); plain comparisons, so that the scan prunes by them."""
    found = F.lit(True)
    if start is not None:
        found = found & (F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        found = found & (F.col(column) < F.lit(end).cast("timestamp"))
    return found


def size_band(column: str, size: int) -> Column:
    """Half to twice a size, both included."""
    return F.col(column).between(size // 2, size * 2)


def function_filter(df: DataFrame, category: str | None = None, mapped: bool | None = None) -> DataFrame:
    df = eq_filter(df, category=category)
    return df if mapped is None else df.where(F.col("mapped_field").isNotNull() if mapped else F.col("mapped_field").isNull())


# Folder names that only narrow a scope, and dotted names that are no domains.
BROAD_FOLDERS = ("windows", "users", "program files", "program files (x86)", "programdata", "system32", "syswow64", "temp", "tmp")
NOT_DOMAINS = ("mp.clean", "mp.infected", "string.find", "string.lower", "string.match", "string.len", "table.insert", "bm.get")


def valid_path(path: Column) -> Column:
    """Long enough, with a separator or a dot, and not a lone %variable%."""
    slash = path.contains("\\")
    return path.isNotNull() & (F.length(path) >= 3) & (slash | path.contains("/") | path.contains(".")) & ((F.length(path) >= 5) | slash) & ~(path.startswith("%") & path.endswith("%"))


def internal_path(path: Column) -> Column:
    """A drive, a root folder or a broad system folder alone: scope, not target."""
    low = F.lower(path)
    roots = r"^\^?\.\s*:(\\+\s*(windows|program files( \(x86\))?|programdata|users)?\\*)?$"
    variables = r"^%(systemroot|programfiles|programdata|userprofile)%\\*$"
    return low.rlike(roots) | low.rlike(variables) | F.regexp_extract(low, r"^\\*([^\\]+)\\*$", 1).isin(*BROAD_FOLDERS)


def false_domain(domain: Column) -> Column:
    """No domain: a known dotted name, a file name, too short, or with a part of one letter."""
    parts = F.split(domain, r"\.")
    return domain.isin(*NOT_DOMAINS) | domain.endswith(".lua") | domain.endswith(".exe") | (F.length(domain) < 8) | (F.size(parts) < 2) | F.exists(parts, lambda p: F.length(p) < 2)
