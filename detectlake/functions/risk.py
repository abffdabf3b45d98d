"""Risk of exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("low", "medium", "high", "critical")

# Patterns over lower-case paths, their level (position in LEVELS) and the reason.
PATH_PATTERNS = (
    (3, r"^\*$", "Wildcard matches everything"),
    (3, r"\*\*", "Double wildcard can match deeply nested paths"),
    (3, r"\\temp\\", "Temp folder is commonly abused"),
    (3, r"\\downloads\\", "Downloads folder is user-writable"),
    (3, r"\\appdata\\local\\temp", "Local temp is commonly abused"),
    (3, r"\\public\\", "Public folder is world-writable"),
    (2, r"\\appdata\\", "AppData is user-writable"),
    (2, r"\\programdata\\", "ProgramData may be writable"),
    (2, r"\\users\\", "User directories are writable"),
    (2, r"\\\*\.exe$", "Wildcard executable match"),
    (2, r"\\\*\.dll$", "Wildcard DLL match"),
    (2, r"\\\*\.ps1$", "Wildcard PowerShell script"),
    (2, r"\\\*\.bat$", "Wildcard batch file"),
    (2, r"\\\*\.cmd$", "Wildcard command file"),
    (2, r"\\\*\.vbs$", "Wildcard VBScript"),
    (2, r"\\\*\.js$", "Wildcard JavaScript"),
    (1, r"\\windows\\", "Windows directory exclusion"),
    (1, r"\\program files", "Program Files exclusion"),
    (1, r"\\syswow64\\", "SysWOW64 exclusion"),
    (1, r"\\\*\.", "Wildcard with extension"),
    (1, r"\\[^\\]+\\\*$", "Directory-level wildcard"),
    (0, r"\\windows\\system32\\", "System32 exclusion (usually legitimate)"),
    (0, r"\.log$", "Log file exclusion"),
    (0, r"\.txt$", "Text file exclusion"),
    (0, r"\.tmp$", "Temp file exclusion"),
)

ABUSED_PROCESSES = ("powershell", "cmd.exe", "wscript", "cscript", "mshta", "regsvr32", "rundll32", "msiexec", "certutil")
NO_RISK = "No significant risk patterns detected"


def _some(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda c: c.isNotNull())


def path_risk(path: Column, scenarios: Sequence[tuple[str, str, str]] = ()) -> Column:
    """(level, reasons, scenarios): the worst level of all patterns that match, with sorted reasons.

    ``scenarios`` are the caller's: a name, a pattern over the lower-case path, and a technique.
    """
    low = F.lower(path)
    hits = _some(*(F.when(low.rlike(p), F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))) for level, p, reason in PATH_PATTERNS))
    worst = F.coalesce(F.array_max(F.transform(hits, lambda h: h["level"])), F.lit(0))
    reasons = F.when(F.size(hits) > 0, F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["reason"])))).otherwise(F.array(F.lit(NO_RISK)))
    known = [F.when(low.rlike(p), F.struct(F.lit(name).alias("name"), F.lit(technique).alias("technique"))) for name, p, technique in scenarios]
    told = _some(*known) if known else F.array().cast("array<struct<name:string,technique:string>>")
    return F.struct(level_name(worst).alias("level"), reasons.alias("reasons"), told.alias("scenarios"))


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in LEVELS)), rank + 1)


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in LEVELS)), level).cast("int") - 1


def process_risk(name: Column) -> Column:
    """(level, hits): high for a known abused process, medium for a wildcard, low otherwise."""
    low = F.lower(name)
    hits = _some(*(F.when(low.contains(p), F.lit(p)) for p in ABUSED_PROCESSES))
    return F.struct(F.when(F.size(hits) > 0, "high").when(name.contains("*"), "medium").otherwise("low").alias("level"), hits.alias("hits"))
