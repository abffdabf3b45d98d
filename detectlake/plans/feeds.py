"""Registered queries: sources, sinks, streams, set operations and indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import naming, records
from ..scratch import new_folder
from ..sources import readers, sinks
from ..streaming import jobs, periods
from ..streaming.snapshots import Snapshot
from .bind import Catalog, over
from .composite import CALLS, UNDEFINED, calls, undefined
from .registry import query

PART = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType())])


@query("s1_read_catalog", "SELECT p_partkey, p_name, p_size, n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def s1(c: Catalog) -> DataFrame:
    """Typed tables of a folder, only the columns that their schemas name."""
    line = T.StructType([T.StructField("l_partkey", T.LongType())])
    tables = readers.read_catalog(c.spark, c.folder, {"part.parquet": PART, "lineitem.parquet": line})
    counts = tables["lineitem.parquet"].groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return tables["part.parquet"].join(counts, F.col("p_partkey") == F.col("l_partkey"), "left").drop("l_partkey")


@query("s4_entity_listing", over("entity", sql="SELECT CASE WHEN signature_id % 3 > 0 THEN signature_id ELSE -1 END AS signature_id, CASE WHEN signature_id % 2 = 0 THEN threat_name ELSE category || '/' || family || '.' || signature_id END AS threat_name, category, family || '.' || signature_id AS family, CASE WHEN signature_id % 5 > 0 THEN signature_count ELSE 0 END AS signature_count FROM entity"))
def s4(c: Catalog) -> DataFrame:
    """A listing of each entity, some without id, name or count, parsed again; made-up ids are shown as -1."""
    key = F.col("signature_id")
    line = lambda when, label, column: F.when(when, F.concat(F.lit(label), F.col(column).cast("string"), F.lit("\n"))).otherwise("")
    value = F.concat(F.lit("# listing\n"), line(key % 3 > 0, "Threat ID: ", "signature_id"), line(key % 2 == 0, "threat name:  ", "threat_name"), line(key % 5 > 0, "Signatures: ", "signature_count"))
    raw = c.entity.select(F.concat_ws("/", F.lit("/data"), "category", F.concat_ws(".", "family", key.cast("string")), F.lit("_combined.sig")).alias("path"), value.alias("value"), key.alias("known"))
    made = readers.entity_listing(raw.select("path", "value"))
    return made.withColumn("signature_id", F.when(F.col("signature_id") == F.xxhash64("category", "family"), -1).otherwise(F.col("signature_id")))


@query("s5_record_csv", over("payload", sql="SELECT id AS threat_id, category || ', \"' || sig_type_name AS threat_name, size, CASE WHEN length(h) > 10000 THEN substring(h, 1, 10000) || '...' ELSE h END AS hex_data, id % 3 = 0 AS is_lua FROM (SELECT *, lower(hex(encode(text))) AS h FROM payload)"))
def s5(c: Catalog) -> DataFrame:
    """Records written as CSV and read again with their types."""
    path = f"{new_folder(c.spark)}/csv"
    lua = F.when(F.col("id") % 3 == 0, "True").when(F.col("id") % 3 == 1, "false").otherwise("")
    cells = {"threat_id": F.col("id"), "threat_name": F.concat("category", F.lit(', "'), "sig_type_name"), "sig_type": F.lit(1), "sig_type_name": F.col("sig_type_name"), "size": F.col("size"), "offset": F.lit(0).cast("long"), "is_lua": lua, "data": F.col("data")}
    names = [f.name for f in schemas.RECORD_CSV]
    rows = c.payload.select(*(cells[n].alias(n) if n in cells else F.lit(None).cast(schemas.RECORD_CSV[n].dataType).alias(n) for n in names if n != "hex_data"), F.col("data").alias("data"))
    sinks.write_record_csv(rows, path)
    # a record without an id is neither
    known = F.when(F.col("threat_id").isNotNull(), F.col("is_lua")).alias("is_lua")
    return readers.read_record_csv(c.spark, path).select("threat_id", "threat_name", "size", "hex_data", known)


@query("s6_list_sources", over("item", sql="SELECT 'category=' || category AS folder, sum(count(DISTINCT category)) OVER () > 0 AS known FROM item GROUP BY category"))
def s6(c: Catalog) -> DataFrame:
    """An inventory of the folders that a partitioned write made."""
    path = f"{new_folder(c.spark)}/parts"
    sinks.write_partitioned(c.item, path, ["category"])
    found = readers.list_sources(c.spark, path).where(F.col("path").endswith(".parquet"))
    return found.groupBy(F.element_at(F.split("folder", "/"), -1).alias("folder")).agg((F.min("length") > 0).alias("known"))


@query("k1_write_partitioned", over("entity", sql="SELECT category, family, count(*) AS n, CAST(sum(signature_id) AS BIGINT) AS ids FROM entity GROUP BY ALL"))
def k1(c: Catalog) -> DataFrame:
    path = f"{new_folder(c.spark)}/parts"
    sinks.write_partitioned(c.entity, path, ["category", "family"])
    return c.spark.read.parquet(path).groupBy("category", "family").agg(F.count(F.lit(1)).alias("n"), F.sum("signature_id").cast("long").alias("ids"))


FOUND = r"ind AS (SELECT 'ip' AS kind, unnest(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) AS value FROM documents UNION ALL SELECT 'email', unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) FROM documents)"


@query("k3_indicator_lists", "WITH " + FOUND + ", d AS (SELECT DISTINCT kind, value FROM ind) SELECT kind, value, count(*) OVER (PARTITION BY kind) AS n FROM d")
def k3(c: Catalog) -> DataFrame:
    """The lists as they were written, one folder a kind, with the counts that the writer gives."""
    from .analysis import indicators

    path = f"{new_folder(c.spark)}/lists"
    counts = sinks.write_indicator_lists(indicators(c), path)
    return c.spark.read.option("basePath", path).text(path).select("kind", "value").join(counts, "kind")


@query("k9_rule_files", over("entity", sql="SELECT category, count(*) AS rules, CAST(sum(length('rule ' || regexp_replace(threat_name, '[^A-Za-z0-9_]', '_', 'g'))) AS BIGINT) AS characters, count(*) AS blank_lines FROM entity GROUP BY 1"))
def k9(c: Catalog) -> DataFrame:
    """Rules written as one text for each category and read again, line by line."""
    path = f"{new_folder(c.spark)}/rules"
    sinks.write_rules(c.entity.select("category", F.concat(F.lit("rule "), naming.rule_identifier(F.col("threat_name"))).alias("rule_text")), path)
    lines = c.spark.read.text(path)
    return lines.groupBy("category").agg(F.count_if(F.col("value") != "").alias("rules"), F.sum(F.length("value")).cast("long").alias("characters"), F.count_if(F.col("value") == "").alias("blank_lines"))


@query("u3_ordered_distinct", "WITH w AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS w FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)), d AS (SELECT doc_id, w, min(k) AS k FROM w GROUP BY ALL) SELECT doc_id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY k)) AS kept FROM d GROUP BY 1")
def u3(c: Catalog) -> DataFrame:
    """Each text's words without repeats, in the order of their first use."""
    kept = F.array_distinct(F.split("text", " "))
    return c.read("documents").select("doc_id", F.size(kept).cast("long").alias("n"), F.md5(F.array_join(kept, " ")).alias("kept"))


@query("u5_unknown_names", over("script", sql=UNDEFINED + " SELECT id, name FROM calls WHERE name NOT IN (SELECT name FROM defs)"))
def u5(c: Catalog) -> DataFrame:
    """Names found in scripts that no definition has: an anti join, as neither side is bounded."""
    used, defined = calls(c)
    return used.join(undefined(defined), "name", "left_anti").select("id", "name")


@query("u5_unknown_in_row", over("script", sql=", n AS (SELECT id, list_distinct(regexp_extract_all(source, 'href=\"/([^\"]*)\"', 1)) AS names FROM script) SELECT id, array_to_string(list_sort(list_filter(names, lambda x: x NOT IN ('The', 'the', 'and', 'of', 'de', 'la'))), ',') AS unknown FROM n"))
def u5b(c: Catalog) -> DataFrame:
    """The same within a row, against a short list."""
    names = F.regexp_extract_all("source", F.lit('href="/([^"]*)"'), 1)
    known = F.array(*(F.lit(x) for x in ("The", "the", "and", "of", "de", "la")))
    return c.script.select("id", F.array_join(F.array_sort(F.array_except(names, known)), ",").alias("unknown"))


@query("m6_extract_indicators", r"""WITH t AS (SELECT doc_id AS owner, source, text, text AS head FROM documents WHERE source NOT IN ('src0', 'src1')),
      v AS (SELECT 'sha256' AS kind, unnest([sha256(text), sha256(text || 'x')]) AS value, doc_id AS owner FROM documents WHERE source = 'src0' UNION ALL SELECT 'md5', md5(text), doc_id FROM documents WHERE source = 'src1'
      UNION ALL SELECT 'ip', unnest(regexp_extract_all(head, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')), owner FROM t UNION ALL SELECT 'email', unnest(regexp_extract_all(head, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')), owner FROM t UNION ALL SELECT 'url', unnest(regexp_extract_all(head, 'https?://[^\s"''<>]+')), owner FROM t)
    SELECT DISTINCT kind, value, owner FROM v""".replace("\\\\", "\\"))
def m6(c: Catalog) -> DataFrame:
    """Items routed by type: packed digests for two sources, network indicators in the whole text of all others."""
    digest = lambda bits: F.sha2(F.encode("text", "UTF-8"), bits)
    packed = F.unhex(F.concat(digest(256), F.lit("0" * 64), F.sha2(F.encode(F.concat("text", F.lit("x")), "UTF-8"), 256)))
    data = F.when(F.col("source") == "src0", packed).when(F.col("source") == "src1", F.unhex(F.md5("text"))).otherwise(F.encode("text", "UTF-8"))
    items = c.read("documents").select(F.col("doc_id").alias("owner"), F.col("source").alias("sig_type_name"), data.alias("data"))
    return records.extract_indicators(items, {"src0": "SHA256", "src1": "MD5"}, tuple(f"src{i}" for i in range(2, 60)))


def feed(c: Catalog, df: DataFrame, files: int) -> DataFrame:
    """Rows as a stream of so many files, one a batch."""
    path = f"{new_folder(c.spark)}/feed"
    df.repartition(files).write.parquet(path)
    return jobs.file_stream(c.spark, path, df.schema, per_trigger=1)


@query("r1_incremental_ingest", over("version", sql="SELECT o_orderkey, v.version FROM orders JOIN version v ON v.version = CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) WHERE v.version NOT IN (SELECT version FROM version WHERE files % 2 = 0)"))
def r1(c: Catalog) -> DataFrame:
    """Orders as they arrive, but for those of versions that are known."""
    version = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    stream = feed(c, c.read("orders").select("o_orderkey", version.alias("version")), 3)
    folder = new_folder(c.spark)
    jobs.incremental_ingest(stream, f"{folder}/checkpoint", lambda: c.version.where("files % 2 = 0"), jobs.by_epoch(f"{folder}/out")).awaitTermination()
    return c.spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def change_rows(c: Catalog) -> DataFrame:
    """New rows of orders, and deletions of those that the new snapshot lacks, each key also once in an older state."""
    new = c.snapshot_new.select("key", "status", "price", F.lit(False).alias("gone"), F.lit(2).alias("at"))
    old = c.snapshot_old.select("key", F.lit("old").alias("status"), "price", F.lit(False).alias("gone"), F.lit(1).alias("at"))
    gone = c.snapshot_old.join(c.snapshot_new, "key", "left_anti").select("key", F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("price"), F.lit(True).alias("gone"), F.lit(2).alias("at"))
    return new.unionByName(old).unionByName(gone)


CHANGED = "d AS (SELECT key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.status IS NOT DISTINCT FROM n.status AND o.price IS NOT DISTINCT FROM n.price THEN 'same' ELSE 'updated' END AS change, o.status AS was, n.status AS is_now, o.price AS cost FROM snapshot_old o FULL JOIN snapshot_new n USING (key))"


@query("r2_change_feed", over("snapshot_old", "snapshot_new", sql=", " + CHANGED + " SELECT key, change, coalesce(was, '') AS was, coalesce(is_now, '') AS is_now FROM d WHERE change <> 'same'"))
def r2(c: Catalog) -> DataFrame:
    """What changed, deletions too, over several files and batches: the last row of a key counts, and what is as it was makes no change."""
    folder = new_folder(c.spark)
    path = f"{folder}/feed"
    change_rows(c).repartition(8, "key").write.parquet(path)
    stream = jobs.file_stream(c.spark, path, change_rows(c).schema, per_trigger=4)
    jobs.change_feed(stream, folder, c.snapshot_old, ["status", "price"], "key", "at", "gone").awaitTermination()
    changes = c.spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/changes")
    return changes.select("key", "change", F.coalesce("before.status", F.lit("")).alias("was"), F.coalesce("after.status", F.lit("")).alias("is_now"))


@query("r2_snapshot_after", over("snapshot_new", sql="SELECT key, status, price FROM snapshot_new"))
def r2b(c: Catalog) -> DataFrame:
    """The snapshot that the change feed leaves, after several batches of which the keys are apart."""
    folder = new_folder(c.spark)
    path = f"{folder}/feed"
    change_rows(c).repartition(3, "key").write.parquet(path)
    stream = jobs.file_stream(c.spark, path, change_rows(c).schema, per_trigger=1)
    jobs.change_feed(stream, folder, c.snapshot_old, ["status", "price"], "key", "at", "gone").awaitTermination()
    return Snapshot.open(c.spark, f"{folder}/snapshot").read().select("key", "status", "price")


@query("r3_streamed_daily_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def r3(c: Catalog) -> DataFrame:
    """The daily counts of the change feed as a stream over the same files, run until nothing is left."""
    stream = jobs.file_stream(c.spark, f"{c.folder}/events.parquet*", c.read("events").schema)
    changes = stream.select(F.col("ts").cast("timestamp").alias("changed_at"))
    days, _ = jobs.run_to_files(jobs.daily_counts(changes, late=None), "update", ["day"])
    return days.select(F.col("day").cast("string").alias("day"), "n")


def even_files(rows: DataFrame, least: int) -> int:
    """Into how many files each part of some rows can be dealt so that none stays empty, which Spark wouldn't write.

    ``least`` is the number of rows of the smallest part: one of its tasks has at least a task's share of
    them, and deals them out in turn.
    """
    tasks = rows.rdd.getNumPartitions()
    return max(1, min(tasks, least // tasks))


@query("r4_late_rows", "WITH e AS (SELECT ts, CAST(ts AS DATE) AS day, event_id % 7 AS part FROM events), w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM e WHERE part < 5) SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM e, w WHERE part < 6 OR day + INTERVAL 1 DAY > mark GROUP BY 1")
def r4(c: Catalog) -> DataFrame:
    """Daily counts in three batches, of which the last holds rows from before the watermark: those are dropped.

    A batch's late rows are told by the watermark that the batch before it had begun with.
    """
    path = f"{new_folder(c.spark)}/feed"
    rows = c.read("events").select(F.col("ts").cast("timestamp").alias("changed_at"), (F.col("event_id") % 7).alias("part"))
    parts = ("part < 5", "part = 5", "part = 6")
    files = even_files(rows, min(rows.agg(*(F.count_if(F.expr(p)) for p in parts)).first()))
    for part in parts:  # the file source takes older files first
        rows.where(part).repartition(files).write.mode("append").parquet(path)
    stream = jobs.file_stream(c.spark, path, rows.schema, per_trigger=files)
    days, _ = jobs.run_to_files(jobs.daily_counts(stream.select("changed_at")), "update", ["day"])
    return days.select(F.col("day").cast("string").alias("day"), "n")


@query("r5_streamed_entity_state", "SELECT event_type AS entity_type, user_id AS entity_id, count(*) AS n, CAST(max(ts) AS VARCHAR) AS last_at FROM events GROUP BY ALL")
def r5(c: Catalog) -> DataFrame:
    stream = feed(c, c.read("events").select(F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("changed_at")), 3)
    state, _ = jobs.run_to_files(jobs.entity_state(stream), "update", ["entity_type", "entity_id"])
    return state.select("entity_type", "entity_id", "n", F.col("last_at").cast("string").alias("last_at"))


@query("r5_ended_periods", """WITH e AS (SELECT event_type, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts) <= INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM events),
    p AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type, user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT event_type AS entity_type, user_id AS entity_id, CAST(min(ts) AS VARCHAR) AS first_at, CAST(max(ts) AS VARCHAR) AS last_at, count(*) AS n FROM p GROUP BY event_type, user_id, k HAVING max(ts) + INTERVAL 3 DAY < (SELECT max(ts) FROM events)""")
def r5_periods(c: Catalog) -> DataFrame:
    """Periods of activity that event time has passed, from a stream of three batches in order of time; their state is gone."""
    rows = c.read("events").select(F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("changed_at"))
    path = f"{new_folder(c.spark)}/feed"
    span = rows.agg(F.min("changed_at").alias("a"), F.max("changed_at").alias("b")).first()
    third = (span.b - span.a) / 3 if span.a else None
    at = F.col("changed_at")
    parts = [at.isNotNull()] if third is None else [at < F.lit(span.a + third), (at >= F.lit(span.a + third)) & (at < F.lit(span.a + 2 * third)), at >= F.lit(span.a + 2 * third)]
    files = even_files(rows, min(rows.agg(*(F.count_if(p) for p in parts)).first()))
    for part in parts:  # the file source takes older files first
        rows.where(part).repartition(files).write.mode("append").parquet(path)
    stream = jobs.file_stream(c.spark, path, rows.schema, per_trigger=files)
    with periods.use_timers(c.spark):
        found, _ = jobs.run_to_files(periods.ended_periods(stream, 2 * 86_400), "append")
    return found.select("entity_type", "entity_id", F.col("first_at").cast("string").alias("first_at"), F.col("last_at").cast("string").alias("last_at"), "n")


@query("r6_distinct_scripts", "SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def r6(c: Catalog) -> DataFrame:
    """Contents as they come in, each once, also across batches."""
    rows = c.read("documents").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), F.timestamp_seconds(F.col("doc_id") + 1_000_000_000).alias("at"))
    found, _ = jobs.run_to_files(jobs.distinct_scripts(feed(c, rows, 2), "at", "3650 days"), "append")
    return found.select("content_hash")


@query("r7_enriched_scripts", over("script", sql=CALLS + " SELECT s.id, length(s.source) AS chars, c.name, d.defined_in AS rule FROM script s LEFT JOIN calls c USING (id) LEFT JOIN defs d USING (name)"))
def r7(c: Catalog) -> DataFrame:
    """Scripts as they come in, with the names they hold and the rules behind those."""
    _, defined = calls(c)
    stream = feed(c, c.script.select("id", "source"), 2)
    names = F.regexp_extract_all("source", F.lit('href="/([^"]*)"'), 1)
    rows = jobs.enriched(stream, names, defined.withColumnRenamed("defined_in", "rule"), chars=F.length("source").cast("long"))
    found, _ = jobs.run_to_files(rows.select("id", "chars", "name", "rule"), "append")
    return found


@query("r8_publish_unchanged", over("script", sql="SELECT id, content_hash, length(source) AS result FROM script WHERE id % 5 <> 0 AND id % 4 <> 1"))
def r8(c: Catalog) -> DataFrame:
    """Results of scripts, but for those whose source has changed since or that aren't pending any more."""
    folder = new_folder(c.spark)
    stream = feed(c, c.script.select("id", "content_hash", F.length("source").cast("long").alias("result")), 2)
    now = c.script.select("id", F.when(F.col("id") % 5 == 0, F.lit("changed")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("id") % 4 == 1, "done").otherwise("pending").alias("status"))
    jobs.publish_unchanged(stream, folder, lambda: now).awaitTermination()
    return jobs.published(c.spark, folder).select("id", "content_hash", "result")


@query("s6_table_inventory", "SELECT 'pages' AS \"table\", count(*) AS rows FROM pages UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations")
def s6b(c: Catalog) -> DataFrame:
    counts: list[DataFrame] = [c.read(t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows") for t in ("pages", "documents", "conversations")]
    return reduce(DataFrame.unionByName, counts)
