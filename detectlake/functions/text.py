"""Column expressions over bytes and text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def latin(data: Column) -> Column:
    """Bytes as text with one character a byte."""
    return F.decode(data, "ISO-8859-1")


def printable_runs(data: Column, least: int = 4) -> Column:
    """Runs of at least ``least`` printable ASCII bytes."""
    return F.regexp_extract_all(latin(data), F.lit(f"([\\x20-\\x7e]{{{least},}})"), 1)


def searchable_text(data: Column, type_name: Column, text_types: tuple[str, ...]) -> Column:
    """Runs joined by spaces for text-bearing types (a missing type name is one); '' otherwise."""
    bearing = type_name.isNull() | (type_name == "") | type_name.isin(*text_types)
    return F.when(bearing & data.isNotNull(), F.array_join(printable_runs(data, 3), " ")).otherwise("")


def printable_share(data: Column, white_space: bool = True) -> Column:
    """Share of bytes that are printable (with tab, CR and LF if asked); null for no bytes."""
    odd = F.regexp_count(latin(data), F.lit(r"[^\x20-\x7e\t\r\n]" if white_space else r"[^\x20-\x7e]"))
    return F.when(F.octet_length(data) > 0, 1 - odd / F.octet_length(data))


def pattern_literal(data: Column, cap: int | None = None) -> Column:
    """A quoted string if all bytes are printable and plain, spaced upper-case hex in braces otherwise."""
    data = data if cap is None else F.substring(data, 1, cap)
    plain = latin(data)
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(plain, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    spaced = F.concat(F.lit("{ "), F.trim(F.regexp_replace(F.hex(data), "(..)", "$1 ")), F.lit(" }"))
    return F.when(plain.rlike(r"\A[\x20-\x7e]+\z"), quoted).otherwise(spaced)


def entropy(data: Column) -> Column:
    """Shannon entropy over bytes, four decimals, halves up as in SQL; 0 for none, null for null. Bytes are counted in Arrow batches."""

    @F.pandas_udf("double")
    def bits(values: pd.Series) -> pd.Series:
        def one(v: bytes | None) -> float | None:
            if v is None:
                return None
            n = np.bincount(np.frombuffer(v, np.uint8))
            p = n[n > 0] / max(1, n.sum())
            return float(np.floor(abs((p * np.log2(p)).sum()) * 1e4 + 0.5) / 1e4)

        return values.map(one, na_action="ignore").astype("float64")

    return bits(data)


# Leading bytes in hex, and what they begin.
MAGIC = (
    ("4D5A", "PE/DOS Executable"),
    ("7F454C46", "ELF Executable"),
    ("504B0304", "ZIP Archive"),
    ("504B0506", "ZIP Archive (empty)"),
    ("504B0708", "ZIP Archive (spanned)"),
    ("89504E470D0A1A0A", "PNG Image"),
    ("474946383761", "GIF Image (87a)"),
    ("474946383961", "GIF Image (89a)"),
    ("FFD8FF", "JPEG Image"),
    ("25504446", "PDF Document"),
    ("526172211A07", "RAR Archive"),
    ("1F8B", "GZIP Compressed"),
    ("425A", "BZIP2 Compressed"),
    ("D0CF11E0", "OLE/MS Office"),
    ("52494646", "RIFF Container (WAV/AVI)"),
    ("CAFEBABE", "Java Class File"),
    ("FEEDFACE", "Mach-O 32-bit"),
    ("FEEDFACF", "Mach-O 64-bit"),
    ("CFFAEDFE", "Mach-O 64-bit (reversed)"),
    ("53514C69746520666F726D61742033", "SQLite Database"),
    ("72656766", "Windows Registry Hive"),
    ("3C21444F4354595045", "HTML/XML Document"),
    ("3C3F786D6C", "XML Document"),
)


def magic(data: Column, known: tuple[tuple[str, str], ...] = MAGIC) -> Column:
    """Meanings of all known leading bytes that the data has, in the order known."""
    head = F.hex(F.substring(data, 1, max(len(h) for h, _ in known) // 2))
    return F.filter(F.array(*(F.when(head.startswith(h), F.lit(m)) for h, m in known)), lambda m: m.isNotNull())


def pattern_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """(term, offset) of every occurrence, overlapping ones too, by term and offset (from 0)."""

    def hits(term: str) -> Column:
        # splitting before each occurrence gives pieces whose lengths add up to the offsets
        quoted = "".join(f"\\{c}" if not c.isalnum() else c for c in term)
        pieces = F.split(text, f"(?={quoted})")
        sums = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
        real = F.filter(sums, lambda at: F.substr(text, at + 1, F.lit(len(term))) == term)
        return F.transform(F.array_distinct(real), lambda at: F.struct(F.lit(term).alias("term"), at.alias("offset")))

    return F.concat(*(hits(t) for t in terms))


def string_class(s: Column, scheme: str = "bytes") -> Column:
    """The first rule that fits; scheme ``bytes`` has nine classes, ``display`` another order of seven."""
    low = F.lower(s)
    some = lambda column, *parts: F.coalesce(column.rlike("|".join(p.replace("\\", "\\\\").replace(".", "\\.").replace("+", "\\+") for p in parts)), F.lit(False))
    if scheme == "display":
        return (
            F.when(some(low, "http://", "https://", "ftp://"), "URL")
            .when(some(low, "\\appdata\\", "\\users\\", "program files", "\\roaming\\", "\\local\\"), "Path")
            .when(some(low, ".dll", ".exe", ".sys"), "File")
            .when(some(low, "password", "credential", "cookie", "token", "encrypted", "decrypt"), "Credential")
            .when(some(low, "chrome", "firefox", "opera", "browser", "edge", "yandex"), "Browser")
            .when(some(low, "hkey_", "\\software\\", "\\currentversion\\"), "Registry")
            .otherwise("String")
        )
    return (
        F.when(some(low, ".exe", ".dll", ".sys", ".bat", ".cmd", ".ps1", ".vbs"), "executable")
        .when(some(s, "\\", "/"), "path")
        .when(some(low, "hkey_", "currentversion"), "registry")
        .when(some(s, "@") & some(s, "."), "email")
        .when(some(s, ".") & (F.length(F.element_at(F.split(s, r"\."), -1)) <= 4), "domain")
        .when(some(s, "Alloc", "Create", "Write", "Read", "Open", "Query", "Get", "Set", "Load"), "api")
        .when(some(low, "cmd", "powershell", "wscript", "cscript", "mshta"), "command")
        .otherwise("string")
    )


def hex_dump(data: Column, width: int = 16) -> Column:
    """Lines of offset, spaced hex and ASCII (a dot for what isn't printable), joined by line feeds."""
    length = F.octet_length(data)

    def line(at: Column) -> Column:
        part = F.substr(data, at + 1, F.lit(width))
        spaced = F.rpad(F.trim(F.regexp_replace(F.hex(part), "(..)", "$1 ")), width * 3 - 1, " ")
        return F.concat(F.lpad(F.lower(F.hex(at)), 8, "0"), F.lit("  "), spaced, F.lit("  "), F.regexp_replace(latin(part), r"[^\x20-\x7e]", "."))

    return F.when(length > 0, F.array_join(F.transform(F.sequence(F.lit(0), length - 1, F.lit(width)), line), "\n")).otherwise("")


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


URL, IPV4, EMAIL = r"(https?://[^\s\"'<>]+)", r"\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"


def tagged(kind: str, values: Column) -> Column:
    """Values as structs of kind and value."""
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def network_indicators(text: Column, prefix: int = 10_000, most: int = 1_000) -> Column:
    """(kind, value) of URLs, IPv4 addresses and e-mail addresses in the head of a text; the bounds are the operator's own."""
    head = F.substring(text, 1, prefix)
    kinds = (("url", URL), ("ip", IPV4), ("email", EMAIL))
    return F.concat(*(tagged(k, F.slice(F.array_distinct(F.regexp_extract_all(head, F.lit(p), 1)), 1, most)) for k, p in kinds))


def content_keys(data: Column) -> dict[str, Column]:
    return {"sha256": F.sha2(data, 256), "md5": F.md5(data), "hex": F.lower(F.hex(data)), "size": F.octet_length(data)}
