"""What items' bytes are made of, item by item and by entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import records, text
from .dictionary import term_hits

KINDS = ("magic", "pattern", "string", "null")


def item_profiles(items: DataFrame, terms: DataFrame, least: int = 4) -> DataFrame:
    """(id, owner, size, entropy, magic, and bytes and number of regions of each kind, terms) of each item.

    Reads id, owner and data. ``terms`` has a column term; ``terms`` of the result lists those that the data,
    read as ISO-8859-1, holds, with the number of their hits. Regions are those of magic bytes, strings and
    runs of nulls. Null data counts as empty; repeated ids get the hits of each of their rows.
    """
    data = F.coalesce("data", F.lit(b""))
    whole = F.coalesce(records.regions(data, (), least), F.array().cast(records.REGION_TYPE))
    rows = items.select("id", "owner", F.octet_length(data).alias("size"), text.entropy(data).alias("entropy"), text.magic(data).alias("magic"), whole.alias("regions"))
    of = lambda k: F.filter("regions", lambda r: r["kind"] == k)
    for k in ("magic", "string", "null"):
        rows = rows.withColumns({f"{k}_regions": F.size(of(k)), f"{k}_bytes": F.aggregate(of(k), F.lit(0).cast("long"), lambda acc, r: acc + r["length"])})
    hits = term_hits(items.select("id", text.latin(data).alias("latin")), "id", "latin", terms)
    found = hits.groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.sum("n").alias("hits"))
    return rows.drop("regions").join(found, "id", "left").withColumns({"terms": F.coalesce("terms", F.array().cast("array<string>")), "hits": F.coalesce("hits", F.lit(0).cast("long"))})


def entity_profiles(items: DataFrame, terms: DataFrame, least: int = 4) -> DataFrame:
    """The same by owner: sums over its items, the range of entropies, all magic meanings and all terms, sorted.

    Lists are made of distinct values, which are counted before they are gathered.
    """
    each = item_profiles(items, terms, least)
    sums = [F.sum(c).cast("long").alias(c) for c in ("size", "hits", *(f"{k}_{w}" for k in ("magic", "string", "null") for w in ("regions", "bytes")))]
    totals = each.groupBy("owner").agg(F.count(F.lit(1)).alias("items"), F.min("entropy").alias("least_entropy"), F.max("entropy").alias("most_entropy"), *sums)
    for c in ("magic", "terms"):
        told = each.select(F.col("owner").alias("__owner"), F.explode(c).alias("x")).distinct().groupBy("__owner").agg(F.array_sort(F.collect_list("x")).alias(c))
        totals = totals.join(told, F.col("owner").eqNullSafe(F.col("__owner")), "left").drop("__owner").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return totals
