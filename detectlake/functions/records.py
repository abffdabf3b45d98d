"""Packed records."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .text import MAGIC, latin, network_indicators, searchable_text

RULE_TYPE = "struct<threshold:int,subrules:array<struct<weight:int,bytes:binary>>>"
#: Widths in bytes of the digests that a list of each kind holds.
DIGEST_WIDTHS = {"MD5": 16, "SHA1": 20, "SHA256": 32, "SHA512": 64}


def parse_rule(data: bytes, coded: bool = False) -> dict | None:
    """A weighted rule: 2 bytes, threshold, count (16 bits each), 1 byte, then weight, size (and a code byte), bytes.

    Ends at the first sub-rule that is cut off; None if even the head is.
    """
    if len(data) < 7:
        return None
    threshold, count, at, head, out = int.from_bytes(data[2:4], "little"), int.from_bytes(data[4:6], "little"), 7, 4 if coded else 3, []
    for _ in range(count):
        if at + head > len(data) or at + head + data[at + 2] > len(data):
            break
        size = data[at + 2]
        out.append({"weight": int.from_bytes(data[at : at + 2], "little"), "bytes": data[at + head : at + head + size]})
        at += head + size
    return {"threshold": threshold, "subrules": out}


def weighted_rule(data: Column, coded: bool = False) -> Column:
    """The parsed rule; null for null or cut-off heads."""

    @F.pandas_udf(RULE_TYPE)
    def parse(values: pd.Series) -> pd.DataFrame:
        rows = [None if v is None else parse_rule(bytes(v), coded) for v in values]
        return pd.DataFrame({"threshold": [r and r["threshold"] for r in rows], "subrules": [r and r["subrules"] for r in rows]})

    parsed = parse(data)
    return F.when(parsed["subrules"].isNotNull(), parsed)


def total_weight(rule: Column) -> Column:
    return F.aggregate(rule["subrules"], F.lit(0), lambda acc, s: acc + s["weight"])


# What the byte behind 0x90 stands for.
WILDCARDS = {"9000": "end", "9001": "any {n}", "9002": "any up to {n}", "9003": "any of {n}", "9004": "set {n}", "9005": "end of set"}


def wildcards(data: Column) -> Column:
    """Names of the wildcard codes in a pattern's bytes, in order."""
    codes = F.regexp_extract_all(F.regexp_replace(F.hex(data), "(..)", "$1 "), F.lit(r"(90 0[0-5])"), 1)
    names = F.create_map(*(F.lit(x) for k, v in WILDCARDS.items() for x in (f"{k[:2]} {k[2:]}", v)))
    return F.transform(codes, lambda c: F.element_at(names, c))


def hash_list(data: Column, kind: Column) -> Column:
    """Packed digests as lower-case hex, without all-zero ones.

    The width follows the declared kind; for an unknown kind the widest of 64, 32, 20 and 16 that divides the
    length. What is left over at the end is no digest.
    """
    length = F.octet_length(data)
    declared = F.element_at(F.create_map(*(F.lit(x) for k, w in DIGEST_WIDTHS.items() for x in (k, w))), kind)
    guessed = F.when(length % 64 == 0, 64).when(length % 32 == 0, 32).when(length % 20 == 0, 20).otherwise(16)
    width = F.coalesce(declared, guessed)
    count = F.floor(length / width).cast("int")
    whole = F.lower(F.hex(data))
    made = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(whole, i * width * 2 + 1, width * 2))
    return F.when(count > 0, F.filter(made, lambda h: ~h.rlike("^0*$"))).otherwise(F.array().cast("array<string>"))


REGION_TYPE = "array<struct<kind:string,offset:int,length:int>>"


def regions_of(data: bytes, terms: tuple[bytes, ...] = (), least: int = 4, nulls: int = 8) -> list[dict]:
    """Magic bytes, terms, strings and null runs by offset; later kinds give way where they would overlap earlier ones."""
    found = [("magic", 0, len(h) // 2) for h, _ in MAGIC if data.startswith(bytes.fromhex(h))][:1]
    found += [("pattern", m.start(), len(t)) for t in terms for m in re.finditer(re.escape(t), data)]
    found += [("string", m.start(), len(m[0])) for m in re.finditer(rb"[\x20-\x7e]{%d,}" % least, data)]
    found += [("null", m.start(), len(m[0])) for m in re.finditer(rb"\x00{%d,}" % nulls, data)]
    # what is taken stays sorted by offset and apart, so that only the two neighbours of a place can overlap
    taken: list[tuple[int, int, str]] = []
    for kind, start, length in found:
        i = bisect.bisect(taken, (start,))
        if (i == 0 or sum(taken[i - 1][:2]) <= start) and (i == len(taken) or start + length <= taken[i][0]):
            taken.insert(i, (start, length, kind))
    return [{"kind": kind, "offset": start, "length": length} for start, length, kind in taken]


#: Bytes of items whose lists are held as Python values at a time.
PIECE = 4 << 20


def listed(values: pa.Array, names: Sequence[str], types: Sequence[pa.DataType], rows: Callable[[bytes], Iterable[tuple]]) -> pa.Array:
    """A list of structs for each item, null for null ones; what is made of some items becomes Arrow's before the next."""
    kind, pieces = pa.list_(pa.struct(list(zip(names, types, strict=True)))), []

    def close(ends: list, made: list) -> None:
        columns = list(zip(*made, strict=True)) or [()] * len(names)
        pieces.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], list(names))).cast(kind))

    ends, made, size = [], [], 0
    for v in values:
        # a null list is a null place with the next list's start behind it
        ends.append(len(made) if v.is_valid else None)
        if v.is_valid:
            data = v.as_py()
            made += rows(data)
            size += len(data)
        if size >= PIECE:
            close([*ends, len(made)], made)
            ends, made, size = [], [], 0
    if ends:
        close([*ends, len(made)], made)
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)


def regions(data: Column, terms: tuple[bytes, ...] = (), least: int = 4, nulls: int = 8) -> Column:
    """The regions of each item as an array of kind, offset and length, by offset; null data has none."""

    @F.arrow_udf(REGION_TYPE)
    def read(values: pa.Array) -> pa.Array:
        return listed(values, ("kind", "offset", "length"), (pa.string(), pa.int32(), pa.int32()), lambda v: [(x["kind"], x["offset"], x["length"]) for x in regions_of(v, terms, least, nulls)])

    return read(data)


def strings_with_context(data: Column, least: int = 4, around: int = 16) -> Column:
    """(text, offset, context): printable runs with the hex of some bytes around them; null data has none."""
    run = re.compile(rb"[\x20-\x7e]{%d,}" % least)

    @F.arrow_udf("array<struct<text:string,offset:int,context:string>>")
    def read(values: pa.Array) -> pa.Array:
        one = lambda v: [(m[0].decode("ascii"), m.start(), v[max(0, m.start() - around) : m.end() + around].hex().upper()) for m in run.finditer(v)]
        return listed(values, ("text", "offset", "context"), (pa.string(), pa.int32(), pa.string()), one)

    return read(data)


def extract_indicators(items: DataFrame, hash_types: dict[str, str], url_types: tuple[str, ...] = ()) -> DataFrame:
    """(kind, value, owner) of all items, each routed by its type (M6).

    Reads owner, sig_type_name and data. ``hash_types`` maps type names to the kind of digests that they pack
    (see DIGEST_WIDTHS); items of other types, or without one, are searched for network indicators, those of
    ``url_types`` whole and not only in their head. Null data gives nothing.
    """
    kinds = F.create_map(*(F.lit(x) for pair in hash_types.items() for x in pair)) if hash_types else F.create_map().cast("map<string,string>")
    kind = F.when(F.col("sig_type_name").isNotNull(), F.element_at(kinds, F.col("sig_type_name")))
    plain = latin(F.col("data"))
    digests = F.transform(hash_list(F.col("data"), kind), lambda h: F.struct(F.lower(kind).alias("kind"), h.alias("value")))
    whole = F.coalesce(F.col("sig_type_name").isin(*url_types), F.lit(False)) if url_types else F.lit(False)
    found = F.when(kind.isNotNull(), digests).when(whole, network_indicators(plain, 1 << 30, 1 << 30)).otherwise(network_indicators(plain))
    return items.where(F.col("data").isNotNull()).select("owner", F.explode(found).alias("x")).select("x.kind", "x.value", "owner").distinct()


def ingest(records: DataFrame, names: dict[int, str], types: dict[str, tuple[str, str | None]], text_types: tuple[str, ...], begin: int = 0x5C, end: int = 0x5D) -> DataFrame:
    """Items of a container: each record with its enclosing block's id and name, its class, text and digest (M2).

    ``names`` gives type names by code (others have none), ``types`` their category and subcategory, and
    ``text_types`` bear text. The begin record holds the id (32 bits), 6 bytes, the name's length, 2 bytes and
    the name; one shorter than 13 bytes counts as id 0 without a name. Records outside of blocks have no owner.
    """
    from ..operators.windows import assign_blocks
    from .classify import type_category
    from .naming import fix_name, parse_name

    code = F.col("sig_type")
    # what reads containers runs once
    records = materialise(records, "records")
    little = lambda at, n: F.conv(F.concat(*(F.hex(F.substring("data", at + i, 1)) for i in reversed(range(n)))), 16, 10).cast("long")
    fits = F.octet_length("data") >= 13
    head = {
        "owner": F.when(fits, little(1, 4)).otherwise(0),
        "owner_name": F.when(fits, fix_name(F.decode(F.substr("data", F.lit(14), little(11, 1).cast("int")), "ISO-8859-1"))).otherwise(""),
    }
    items = assign_blocks(records, code == begin, code == end, head).where(~code.isin(begin, end))
    name = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("sig_type"))
    items = items.withColumn("sig_type_name", name)
    shown = searchable_text(F.col("data"), F.col("sig_type_name"), text_types)
    family = parse_name(F.col("owner_name"))["family"]
    return items.select("path", "offset", "owner", "owner_name", family.alias("family"), "sig_type", "sig_type_name", "size", F.sha2("data", 256).alias("data_hash"), type_category(F.col("sig_type_name"), shown, types).alias("class"), shown.alias("searchable"), "data")
