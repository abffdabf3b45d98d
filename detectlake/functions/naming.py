"""Names of detections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known prefixes; a name that lost its first letter begins with the rest of one.
PREFIXES = (
    "Trojan", "TrojanDownloader", "TrojanDropper", "TrojanSpy", "TrojanClicker", "Virus", "Worm", "Ransom",
    "Backdoor", "Exploit", "HackTool", "PUA", "Behavior", "Adware", "Spammer", "SupportScam", "DoS", "VirTool",
    "PWS", "Phish", "MonitoringTool", "Program", "BrowserModifier", "Misleading", "SoftwareBundler", "Rogue",
    "RemoteAccess", "SettingsModifier", "Spyware", "VulnerableDriver",
)


def fix_name(name: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """Strip leading control and replacement characters; give a known prefix its lost first letter back.

    Only a whole prefix before the colon is repaired, so that no valid name is rewritten.
    """
    clean = F.regexp_replace(name, "^[\\x00-\\x1f\\ufffd]+", "")
    lost = F.create_map(*(F.lit(x) for p in prefixes for x in (p[1:], p)))
    head = F.substring_index(clean, ":", 1)
    return F.concat(F.coalesce(F.element_at(lost, head), head), F.substr(clean, F.length(head) + 1))


def parse_name(name: Column) -> Column:
    """(category, family): before the first colon, and from there to the first slash; a name without colon is its own category."""
    fixed = fix_name(name)
    has = fixed.contains(":")
    category = F.substring_index(fixed, ":", 1)
    rest = F.substr(fixed, F.length(category) + 2)
    return F.struct(category.alias("category"), F.when(has, F.substring_index(rest, "/", 1)).otherwise("Unknown").alias("family"))


def name_taxonomy(name: Column, scheme: str = "slash") -> Column:
    """(category, family) in two other schemes.

    ``slash``: family is what follows the first slash, up to a dot; ``platform``: category before the colon
    with its platform (between colon and slash) behind a dot, family the part between slash and dot or '!'.
    """
    kind = F.when(name.contains(":"), F.substring_index(name, ":", 1)).otherwise("Unknown")
    after = F.when(name.contains("/"), F.element_at(F.split(name, "/", 2), 2)).otherwise(name)
    family = F.element_at(F.split(after, r"[.!]", 2), 1)
    if scheme == "platform":
        platform = F.regexp_extract(name, r":([^/]*)/", 1)
        return F.struct(F.when(platform != "", F.concat(kind, F.lit("."), platform)).otherwise(kind).alias("category"), family.alias("family"))
    return F.struct(kind.alias("category"), family.alias("family"))


def rule_identifier(name: Column, fallback: str = "unnamed_rule", longest: int = 128) -> Column:
    """A name as an identifier: other characters become _, no leading digit, at most ``longest`` characters."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9_]", "_")
    plain = F.when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)
    return F.when(F.length(plain) > 0, F.substring(plain, 1, longest)).otherwise(fallback)


def infer_category(function: Column) -> Column:
    low = F.lower(function)
    return (
        F.when(low.contains("rmm"), "rmm_tool")
        .when(low.contains("path") | low.contains("location"), "path")
        .when(low.contains("ext"), "file_extension")
        .when(low.contains("process"), "process")
        .when(low.contains("driver"), "driver")
        .otherwise("unknown")
    )


def infer_field(function: Column) -> Column:
    """The list field that a helper function's name points at; null if none."""
    low = F.lower(function)
    tool = low.contains("rmmtool")
    return (
        F.when(tool & low.contains("path"), "rmm_file_paths")
        .when(tool & low.contains("version"), "rmm_version_info")
        .when(tool & (low.contains("ofn") | low.contains("originalfilename")), "rmm_original_filenames")
        .when(low.contains("exclusion"), "exclusion_paths")
        .when(low.contains("monitored") | low.contains("detection"), "detection_paths")
        .when(low.contains("ext") & (low.contains("file") | low.contains("suspicious")), "file_extensions")
        .when(low.contains("process") | low.contains("interpreter"), "process_names")
        .when(low.contains("driver"), "vulnerable_drivers")
    )


def snake_case(function: Column) -> Column:
    """CamelCase without a leading Is or Get as snake_case."""
    bare = F.regexp_replace(function, "^(Is|Get)", "")
    return F.lower(F.regexp_replace(bare, "(?<!^)([A-Z])", "_$1"))
