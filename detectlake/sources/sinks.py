"""Writers and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import sent

MOST_EXPORTED, MOST_BYTES = 5_000, 16 << 20


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int = 1_000_000) -> None:
    """One folder a key. Rebalancing on the keys makes few files for small keys and splits large ones."""
    df.hint("rebalance", *by).write.option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def hex_cell(data: Column, most: int = 10_000) -> Column:
    whole = F.lower(F.hex(data))
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("..."))).otherwise(whole)


def write_record_csv(df: DataFrame, path: str, include_hex: bool = True, most: int = 10_000, rows_per_file: int = 100_000) -> None:
    """Records as CSV, cells as they are: no space is trimmed, empty texts are quoted and nulls are not.

    Files are kept small, as one whose cells may hold line ends is read by one task.
    """
    out = df.withColumn("hex_data", hex_cell(F.col("data"), most) if include_hex else F.lit("")).drop("data")
    out.write.option("maxRecordsPerFile", rows_per_file).csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_indicator_lists(indicators: DataFrame, path: str) -> DataFrame:
    """A sorted list of distinct values for each kind, and their counts."""
    values = indicators.select("kind", "value").distinct()
    values.repartitionByRange("kind", "value").sortWithinPartitions("kind", "value").write.partitionBy("kind").text(path)
    return values.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def indicator_map(indicators: DataFrame, names: DataFrame) -> DataFrame:
    """Each indicator with the sorted names of its entities, joined by semicolons."""
    rows = indicators.join(names, "owner").select("kind", "value", "name").distinct()
    return rows.groupBy("kind", "value").agg(F.array_join(F.array_sort(F.collect_list("name")), ";").alias("names"))


def id_bounds(rows: DataFrame, parts: int, sample: int = 10_000) -> list:
    """At most ``parts`` - 1 sorted ids that cut the rows into ranges of about equal size, from the ``sample`` least hashes."""
    known = rows.select("id").where(F.col("id").isNotNull())
    ids = sorted({r.id for r in known.orderBy(F.xxhash64("id"), "id").limit(sample).collect()})
    return sorted({ids[len(ids) * i // parts] for i in range(1, parts)}) if ids else []


def rule_corpus(scripts: DataFrame, by: str, most: int | None = None, parts: int = 256) -> DataFrame:
    """Scripts under each of their rules with a header line, numbered by id; at most ``most`` a rule if given.

    A rule can hold any share of all scripts, so none is sorted in one task: ids fall into ranges, counts by
    range give the offset of each, and only within a range of a rule are rows numbered.
    """
    bounds = id_bounds(scripts, parts)
    kind = scripts.schema["id"].dataType
    part = F.size(F.filter(F.array(*(F.lit(x).cast(kind) for x in bounds)), lambda x: x <= F.col("id"))) if bounds else F.lit(0)
    rows = scripts.withColumns({"part": part}).withColumn("rule", F.explode(by))
    before = Window.partitionBy("rule").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("rule", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(F.col("rule").alias("of_rule"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("rule", "part").orderBy("id")))
    placed = placed.join(offsets, F.col("rule").eqNullSafe(F.col("of_rule")) & (F.col("part") == F.col("of_part")))
    rows = placed.withColumn("number", (F.col("offset") + F.col("place")).cast("int"))
    rows = rows if most is None else rows.where(F.col("number") <= most)
    return rows.select("rule", "number", "id", F.concat(F.lit("-- script "), F.col("id").cast("string"), F.lit("\n"), F.col("source")).alias("value"))


def bundle_export(entities: DataFrame, items: DataFrame, ids: list[int]) -> DataFrame:
    """Entities in the caller's order with their items nested as JSON, with their bytes in hex where ``items`` has ``data``.

    Fails, and never cuts, if an id is unknown or the items are too many or too large; one aggregate tells.
    Null data stays null.
    """
    spark, unique = entities.sparkSession, list(dict.fromkeys(ids))
    wanted = spark.createDataFrame([(i, n) for n, i in enumerate(unique)], "signature_id long, position int")
    found = entities.join(sent(wanted, len(unique)), "signature_id")
    own = items.join(sent(wanted.withColumnRenamed("signature_id", "owner"), len(unique)), "owner")
    n = found.count()
    if n < len(unique):
        raise KeyError(f"{len(unique) - n} unknown ids")
    fields = [F.col(x) for x in ("ord", "sig_type", "size")]
    bytes_of = F.col("size")
    if "data" in items.columns:
        # what the export holds counts, not what the item says of itself
        bytes_of = F.greatest("size", F.coalesce(F.octet_length("data"), F.lit(0)))
        fields.append(F.lower(F.hex("data")).alias("data"))
    count, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(bytes_of), F.lit(0))).first()
    if count > MOST_EXPORTED or 2 * size + 512 * count > MOST_BYTES:
        raise ValueError("too many items to export")
    nested = own.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    joined = found.join(nested.withColumnRenamed("owner", "signature_id"), "signature_id", "left")
    return joined.select("position", "signature_id", F.coalesce(F.to_json("items"), F.lit("[]")).alias("items")).orderBy("position")


def payload_dump(data: Column, form: str = "hex", width: int = 16) -> Column:
    """An item's bytes as text: hex lines, raw hex, or a C array."""
    lines = lambda part: F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(width)), lambda at: part(F.hex(F.substr(data, at + 1, F.lit(width)))))
    if form == "raw":
        return F.lower(F.hex(data))
    if form == "hex":
        return F.array_join(lines(lambda h: F.trim(F.regexp_replace(h, "(..)", "$1 "))), "\n")
    if form == "c":
        return F.concat(F.lit("{"), F.array_join(lines(lambda h: F.regexp_replace(h, "(..)", "0x$1,")), "\n"), F.lit("}"))
    raise ValueError(f"unknown form {form!r}")


def manifest(items: DataFrame) -> DataFrame:
    """Totals by category and type as one JSON row for each category."""
    types = items.groupBy("category", "sig_type_name").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))
    row = F.to_json(F.array_sort(F.collect_list(F.struct("sig_type_name", "n", "bytes"))))
    return types.groupBy("category").agg(F.sum("n").alias("items"), F.sum("bytes").alias("bytes"), row.alias("types"))


def write_rules(rules: DataFrame, path: str) -> None:
    """Rule texts (category, rule_text), separated by blank lines, in a folder a category."""
    rules.select("category", F.concat("rule_text", F.lit("\n")).alias("value")).write.partitionBy("category").text(path)


def report_rows(entity: DataFrame, type_counts: DataFrame, strings: DataFrame, related: DataFrame) -> DataFrame:
    """(section, ord, label, value) of a report: type counts, first strings, related entities."""
    number = lambda df, order: df.withColumn("ord", F.row_number().over(Window.orderBy(*order)))
    head = entity.select(F.lit("entity").alias("section"), F.lit(1).alias("ord"), F.col("threat_name").alias("label"), F.col("signature_id").cast("string").alias("value"))
    types = number(type_counts, [F.desc("n"), F.asc("type")]).select(F.lit("types").alias("section"), "ord", F.col("type").alias("label"), F.col("n").cast("string").alias("value"))
    texts = number(strings.orderBy("string").limit(50), ["string"]).select(F.lit("strings").alias("section"), "ord", F.substring("string", 1, 100).alias("label"), F.length("string").cast("string").alias("value"))
    near = number(related.orderBy(F.desc("score"), F.asc("b")).limit(10), [F.desc("score"), F.asc("b")]).select(F.lit("related").alias("section"), "ord", F.col("b").cast("string").alias("label"), F.col("score").cast("string").alias("value"))
    return head.unionByName(types).unionByName(texts).unionByName(near)
