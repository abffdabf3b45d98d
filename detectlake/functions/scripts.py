"""Scripts: extraction, links to rules, logic and risk."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What is extracted from sources, one pattern with one group a field.
PATTERNS = {
    "guids": r"[\"']([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})[\"']",
    "techniques": r"[\"']([Tt][0-9]{4}(?:\.[0-9]{3})?)[\"']",
    "domains": r"(?i)[\"']([a-z0-9][-a-z0-9]{2,}(?:\.[a-z0-9][-a-z0-9]*)*\.(?:com|net|org|io|co|gov|edu|info|biz|us|uk|de|fr|ru|cn|jp|br|au|in|ca|es|it|nl|pl|se|ch|be|at))[\"']",
    "registry_keys": r"(?i)[\"']((?:HK[A-Z]{1,3}|HKEY_[A-Z_]+)\\[^\"']+)[\"']",
    "file_extensions": r"(?i)(?:l_[0-9]+_[0-9]+|ext|extension)\s*==\s*[\"'](\w{2,5})[\"']",
    "process_names": r"(?i)(?:processname|CONTEXT_DATA_PROCESSNAME)[^=]*==\s*[\"']([^\"']+\.exe)[\"']",
    "native_calls": r"\b(Is[A-Z][a-zA-Z]+(?:FilePath|VersionInfo|OFN|Process|Path|File|Tool|Ext))\s*\(",
    "drivers": r"(?i)[\"']([\w-]+\.sys)[\"']",
    "env_variables": r"[\"'](%[^%]+%)[\"']",
    "links": r"(https?://[a-z0-9.-]+)",
}


def extracted(source: Column, field: str, lower: bool = True) -> Column:
    """Sorted distinct matches of one field."""
    found = F.regexp_extract_all(source, F.lit(PATTERNS[field]), 1)
    return F.array_sort(F.array_distinct(F.transform(found, F.lower) if lower else found))


def techniques(source: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(PATTERNS["techniques"]), 1), F.upper)))


def path_context(scripts: DataFrame, key: str, source: str, ahead: int = 8) -> DataFrame:
    """(key, path, kind): path literals of find calls, excluded or detected by the following lines.

    A return of a clean value, or a negated find in the line itself, excludes; an exclusion wins over a
    detection, and a path without either is a detection.
    """
    lines = scripts.select(key, F.posexplode(F.split(source, "\n")).alias("line", "text"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(0, ahead)
    context = F.array_join(F.collect_list("text").over(w), "\n")
    lines = lines.withColumn("path", F.explode_outer(F.regexp_extract_all("text", F.lit(r"(?i)(?:string\.find\)?\s*\([^,]+,|:find\s*\()\s*[\"']([^\"']+)[\"']"), 1))).withColumn("context", context)
    excluded = F.col("text").rlike(r"(?i)\bnot\b.*find") | F.col("context").rlike(r"(?i)return\s+(false|1|true|mp\.CLEAN)")
    kept = lines.where(F.length("path") >= 3).where(F.col("path").rlike(r"[\\/.]"))
    kind = F.max(F.when(excluded, "exclusion").otherwise("detection"))
    return kept.groupBy(key, "path").agg(kind.alias("kind"))


def blocks_of(source: str) -> list[dict]:
    """The functions of one source: name, body up to its matching end, and the string entries of its tables."""
    import re

    words = re.compile(r"--\[\[.*?\]\]|--[^\n]*|\[\[.*?\]\]|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|\b(?:function|do|then|repeat|end|until|elseif)\b", re.DOTALL)
    out: list[dict] = []
    open_at: list[tuple[int, str | None]] = []
    for m in words.finditer(source):
        word = m[0]
        if word == "function":
            name = re.match(r"\s*([\w.:]+)?", source[m.end() : m.end() + 200])[1]
            open_at.append((m.start(), name or ""))
        elif word in ("do", "then", "repeat"):
            open_at.append((m.start(), None))
        elif word == "elseif" and open_at:
            open_at.pop()
        elif word in ("end", "until") and open_at:
            start, name = open_at.pop()
            if name:
                body = source[start : m.end()]
                entries = re.findall(r"\[\s*[\"']([^\"']+)[\"']\s*\]\s*=|[{,]\s*[\"']([^\"']+)[\"']\s*(?=[,}])", body)
                out.append({"name": name, "body": body, "entries": list(dict.fromkeys(a or b for a, b in entries))})
    return out


#: Characters of functions that are held as Python values at a time.
PIECE = 4 << 20


def function_bodies(scripts: DataFrame, key: str, source: str) -> DataFrame:
    """(key, name, body, entries) of every function, nested ones too; nesting needs a stack, so sources go through Arrow batches.

    Sources are taken one by one, and what is found goes on in pieces: neither all sources of a batch nor
    their functions are held as Python values.
    """
    names = [key, "name", "body", "entries"]
    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            rows, size = [], 0
            for k, s in zip(batch.column(0), batch.column(1), strict=True):
                found = blocks_of(s.as_py()) if s.is_valid else []
                rows += [(k.as_py(), f["name"], f["body"], f["entries"]) for f in found]
                size += sum(len(f["body"]) for f in found)
                if size >= PIECE:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return scripts.select(F.col(key).cast("long"), source).mapInArrow(read, f"{key} long, name string, body string, entries array<string>")


def best_definitions(functions: DataFrame, policy: str = "most") -> DataFrame:
    """One definition a name: with most entries (first key on a tie), the last one, or the union of entries."""
    if policy == "union":
        return functions.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("entries")))).alias("entries"))
    order = [F.desc(F.size("entries")), F.asc("id")] if policy == "most" else [F.desc("id")]
    w = Window.partitionBy("name").orderBy(*order, "body")
    return functions.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).select("name", "entries")


def link_rules(source: Column, names: dict[str, str]) -> Column:
    """Sorted rule ids that a source names: quoted ids, and ids of rules whose name occurs in it."""
    named = F.array_compact(F.array(*(F.when(F.lower(source).contains(n.lower()), F.lit(g.lower())) for n, g in sorted(names.items())))) if names else F.array().cast("array<string>")
    return F.array_sort(F.array_union(extracted(source, "guids"), named))


def flags(source: Column, patterns: Mapping[str, str]) -> Column:
    """The names of the patterns that a source holds, in the order given."""
    return F.array_compact(F.array(*(F.when(source.rlike(p), F.lit(k)) for k, p in patterns.items()))) if patterns else F.array().cast("array<string>")


def script_logic(source: Column, checks: Mapping[str, str], outcomes: Mapping[str, str], config: str = r"Get\w*(Exclusions|Locations|Config)", telemetry: Mapping[str, str] | None = None) -> Column:
    """What a source does, from the caller's patterns by name.

    kind is config, detection (some outcome) or helper; entry is the first function defined; flow lists
    checks and outcomes in the order in which they first occur, and trigger is the first check among them.
    """
    found = F.regexp_extract_all(source, F.lit(r"function\s+([\w.:]+)\s*\("), 1)
    reached = flags(source, outcomes)
    kind = F.when(source.rlike(config), "config").when(F.size(reached) > 0, "detection").otherwise("helper")
    steps = F.array_sort(F.array_compact(F.array(*(F.when(source.rlike(p), F.struct(F.regexp_instr(source, F.lit(p)).alias("at"), F.lit(what).alias("what"), F.lit(k).alias("name"))) for what, given in (("check", checks), ("outcome", outcomes)) for k, p in given.items()))))
    first = F.try_element_at(F.filter(steps, lambda x: x["what"] == "check"), F.lit(1))["name"]
    calls = F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(r"\b(mp\.[a-zA-Z_]\w*)"), 1)))
    return F.struct(
        kind.alias("kind"),
        F.try_element_at(found, F.lit(1)).alias("entry"),
        first.alias("trigger"),
        F.transform(steps, lambda x: F.concat(x["what"], F.lit(" "), x["name"])).alias("flow"),
        flags(source, checks).alias("checks"),
        reached.alias("outcomes"),
        flags(source, telemetry or {}).alias("telemetry"),
        F.array_sort(F.array_distinct(found)).alias("functions"),
        techniques(source).alias("techniques"),
        calls.alias("calls"),
    )


def rule_logic(logic: DataFrame, by: str) -> DataFrame:
    """Each rule's scripts by kind, and the checks, outcomes and ways through them that occur, sorted.

    Reads ``by`` and logic (see ``script_logic``). Names are the caller's, so what is gathered is bounded by
    them; ways are counted and the most frequent one is kept.
    """
    kinds = logic.groupBy(by).agg(F.count(F.lit(1)).alias("scripts"), *(F.count_if(F.col("logic.kind") == k).alias(k) for k in ("config", "detection", "helper")))
    names = [logic.select(by, F.explode(f"logic.{f}").alias("name")).groupBy(by).agg(F.array_sort(F.collect_set("name")).alias(f)) for f in ("checks", "outcomes")]
    ways = logic.where(F.size("logic.flow") > 0).groupBy(by, F.array_join("logic.flow", " > ").alias("way")).agg(F.count(F.lit(1)).alias("n"))
    usual = ways.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), "way"))["way"].alias("usual"))
    out = kinds
    for part in (*names, usual):
        out = out.join(part, by, "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"checks": F.coalesce("checks", none), "outcomes": F.coalesce("outcomes", none), "usual": F.coalesce("usual", F.lit(""))})


def resolve_rules(links: DataFrame, calls: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values that rules get by the functions their scripts call, and the names that nothing defines (M9).

    ``links`` has (rule, id), ``calls`` (id, name), ``registry`` (name, field, entries). A function's entries
    go to the list field that it is mapped to; one without a field counts as defined and gives nothing.
    Returns (rule, field, value) and (rule, name), each row once.
    """
    used = links.join(calls, "id").select("rule", "name").distinct().join(registry.select("name", "field", "entries", F.lit(True).alias("known")), "name", "left")
    values = used.where(F.col("field").isNotNull()).select("rule", "field", F.explode("entries").alias("value")).distinct()
    return values, used.where(F.col("known").isNull()).select("rule", "name")


def script_risk(source: Column, risks: Sequence[tuple[int, str]], most: int = 100) -> Column:
    """The sum of the weights of the caller's patterns over all hits, at most ``most``."""
    total = F.lit(0)
    for weight, pattern in risks:
        total = total + F.regexp_count(source, F.lit(pattern)) * weight
    return F.least(total, F.lit(most)).cast("int")
