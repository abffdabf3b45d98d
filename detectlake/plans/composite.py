"""Registered queries: pipelines composed of several operators, and the remaining single ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, naming, records, risk, scripts, text
from ..operators import aggregates, delta, dictionary, filters, paging, profiles, similarity, windows
from ..sources import sinks
from .analysis import PATHS, paths
from .bind import Catalog, over
from .registry import query

PAIRS = """, v AS (SELECT DISTINCT guid, field || ':' || value AS value FROM rule_value), n AS (SELECT guid, count(*) AS n FROM v GROUP BY 1),
    p AS (SELECT a.guid AS a, b.guid AS b, count(*) AS k FROM v a JOIN v b ON a.value = b.value AND a.guid < b.guid GROUP BY ALL),
    r AS (SELECT guid, min(guid) OVER (PARTITION BY x) AS rep FROM (SELECT guid, list_sort(list(value)) AS x FROM v GROUP BY 1)),
    s AS (SELECT p.a, p.b, round(k / (x.n + y.n - k), 4) AS score FROM p JOIN n x ON x.guid = p.a JOIN n y ON y.guid = p.b JOIN r ra ON ra.guid = p.a JOIN r rb ON rb.guid = p.b WHERE ra.rep = p.a AND rb.rep IN (p.a, p.b))"""


def tagged_values(c: Catalog) -> DataFrame:
    """The values of all fields of each rule as numbers, told apart by field, with repeats."""
    return c.rule_code(lambda field, value: F.xxhash64(F.concat(field, F.lit(":"), value)))


@query("f12_min_score", over("rule_value", sql=PAIRS + " SELECT a, b, score FROM s JOIN supplier ON s_suppkey = b WHERE score >= 0.55 AND s_name ILIKE '%1%'"))
def f12(c: Catalog) -> DataFrame:
    pairs = similarity.set_similarity(tagged_values(c), "guid", "value", 0.55)
    names = c.read("supplier").where(filters.icontains("s_name", "1")).select(F.col("s_suppkey").alias("b"))
    return pairs.join(names, "b", "left_semi").select("a", "b", "score")


FUNCTIONS = "SELECT p_partkey AS id, 'Get' || replace(p_name, ' ', '') || p_size AS name, p_type AS category, CASE WHEN p_size > 25 THEN 'exclusion_paths' END AS mapped_field, p_size AS entry_count FROM part"


def functions(c: Catalog) -> DataFrame:
    name = F.concat(F.lit("Get"), F.expr("replace(p_name, ' ', '')"), F.col("p_size").cast("string"))
    return c.read("part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_type").alias("category"), F.when(F.col("p_size") > 25, "exclusion_paths").alias("mapped_field"), F.col("p_size").alias("entry_count"))


@query("f15_function_filter", f"SELECT id, name FROM ({FUNCTIONS}) WHERE category = 'LARGE' AND mapped_field IS NULL")
def f15(c: Catalog) -> DataFrame:
    return filters.function_filter(functions(c), "LARGE", mapped=False).select("id", "name")


@query("p3_item_preview", over("payload", sql="SELECT id, CASE WHEN length(j) > 200 THEN substring(j, 1, 200) || '...' ELSE j END AS preview FROM (SELECT id, array_to_string(regexp_extract_all(text, '[\\x20-\\x7e]{3,}'), ' | ') AS j FROM payload)"))
def p3(c: Catalog) -> DataFrame:
    return c.payload.select("id", paging.preview(text.printable_runs(F.col("data"), 3)).alias("preview"))


@query("p5_top_strings", over("payload", sql="SELECT id, array_to_string(list_transform(regexp_extract_all(text, '[\\x20-\\x7e]{4,}')[1:5], lambda s: substring(s, 1, 40)), '|') AS strings FROM payload"))
def p5(c: Catalog) -> DataFrame:
    return c.payload.select("id", F.array_join(paging.top_strings(text.printable_runs(F.col("data"), 4), 5, 40), "|").alias("strings"))


@query("p12_ranked_registry", f"SELECT name, entry_count FROM ({FUNCTIONS}) ORDER BY entry_count DESC, name, id LIMIT 100")
def p12(c: Catalog) -> DataFrame:
    return functions(c).orderBy(F.desc("entry_count"), "name", "id").limit(100).select("name", "entry_count")


@query("j4_top_items_of_entities", over("entity", "item", sql="SELECT e.signature_id, i.ord FROM entity e, LATERAL (SELECT ord FROM item WHERE owner = e.signature_id ORDER BY ord LIMIT 3) i WHERE e.category = 'PROMO'"))
def j4(c: Catalog) -> DataFrame:
    top = windows.top_n_per_group(c.item, "owner", [F.asc("ord")], 3)
    return c.entity.where("category = 'PROMO'").join(top, F.col("owner") == F.col("signature_id")).select("signature_id", "ord")


# A caller's dictionary: terms, their binary, technique and category.
TERMS = (("ing of", "alpha.exe", "T1059", "shell"), ("that the", "beta.exe", "T1218", "proxy"), ("de la", "gamma.dll", "T1218", "proxy"), ("example.com", "delta.exe", "T1105", "download"))
TERMS_SQL = ", terms(term, bin, technique, category) AS (VALUES " + ", ".join(str(t) for t in TERMS) + "), hits AS (SELECT id, owner, term, bin, technique, terms.category FROM payload, terms WHERE contains(lower(text), term))"


def term_hits(c: Catalog) -> DataFrame:
    """Items with each term of the caller's dictionary in them, in any case."""
    terms = c.spark.createDataFrame(TERMS, "term string, bin string, technique string, category string")
    found = dictionary.term_hits(c.payload.select("id", F.lower("text").alias("low")), "id", "low", terms)
    return found.select("id", "term").join(c.payload.select("id", "owner"), "id").join(terms, "term").select("id", "owner", *terms.columns)


#: A dictionary as large as its table: all runs of three words of the benchmark's passages.
RUNS = r"terms AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS term FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)))"


def runs(c: Catalog) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    three = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))
    return c.read("benchmark").select(w.alias("w")).where(F.size("w") > 2).select(F.explode(three).alias("term")).distinct()


@query("j10_large_dictionary", "WITH " + RUNS + " SELECT doc_id, term, CAST((length(low) - length(replace(low, term, ''))) // length(term) >= 1 AS INTEGER) AS there, CAST(instr(low, term) - 1 AS BIGINT) AS \"offset\" FROM (SELECT doc_id, lower(text) AS low FROM documents), terms WHERE contains(low, term)")
def j10_large(c: Catalog) -> DataFrame:
    found = dictionary.term_hits(c.read("documents").select("doc_id", F.lower("text").alias("low")), "doc_id", "low", runs(c))
    return found.select("doc_id", "term", (F.col("n") >= 1).cast("int").alias("there"), "offset")


@query("j10_dictionary_hits", over("payload", sql=TERMS_SQL + " SELECT id, term, technique FROM hits"))
def j10(c: Catalog) -> DataFrame:
    return term_hits(c).select("id", "term", "technique")


@query("a20_technique_counts", over("payload", sql=TERMS_SQL + " SELECT category, bin, count(*) AS n, count(DISTINCT owner) AS owners FROM hits GROUP BY ROLLUP (category, bin)"))
def a20(c: Catalog) -> DataFrame:
    return term_hits(c).rollup("category", "bin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("owner").alias("owners"))


@query("a18_pattern_union", over("payload", sql=TERMS_SQL + ", o AS (SELECT owner, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes FROM payload GROUP BY 1), t AS (SELECT owner, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM hits GROUP BY 1) SELECT o.*, coalesce(terms, '') AS terms FROM o LEFT JOIN t USING (owner)"))
def a18(c: Catalog) -> DataFrame:
    found = term_hits(c).groupBy("owner").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))
    own = c.payload.groupBy("owner").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("bytes"))
    return own.join(found, "owner", "left").withColumn("terms", F.coalesce("terms", F.lit("")))


@query("m7_binary_abuse", over("payload", sql=TERMS_SQL + " SELECT bin, technique, count(*) AS hits, min(id) AS first_item FROM hits GROUP BY ALL"))
def m7(c: Catalog) -> DataFrame:
    return term_hits(c).groupBy("bin", "technique").agg(F.count(F.lit(1)).alias("hits"), F.min("id").alias("first_item"))


CALLS = ", calls AS (SELECT DISTINCT id, unnest(regexp_extract_all(source, 'href=\"/([^\"]*)\"', 1)) AS name FROM script), defs AS (SELECT name, min(id) AS defined_in FROM calls GROUP BY 1 HAVING count(*) > 2)"
#: The same with names that are called and never defined.
UNDEFINED = CALLS.replace("FROM calls GROUP", "FROM calls WHERE length(name) % 4 <> 1 GROUP")


def calls(c: Catalog) -> tuple[DataFrame, DataFrame]:
    used = c.script.select("id", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit('href="/([^"]*)"'), 1))).alias("name"))
    defined = used.groupBy("name").agg(F.min("id").alias("defined_in"), F.count(F.lit(1)).alias("n")).where("n > 2").drop("n")
    return used, defined


def undefined(defined: DataFrame) -> DataFrame:
    """Definitions without those of some names, which then are called and never defined."""
    return defined.where(F.length("name") % 4 != 1)


@query("j11_calls_to_definitions", over("script", sql=CALLS + " SELECT id, name, defined_in FROM calls JOIN defs USING (name)"))
def j11(c: Catalog) -> DataFrame:
    used, defined = calls(c)
    return used.join(defined, "name").select("id", "name", "defined_in")


REGISTRY = """, reg AS (SELECT name, defined_in, CASE length(name) % 3 WHEN 0 THEN 'path' WHEN 1 THEN 'process' END AS field, [name || '/a', name || '/' || CAST(defined_in % 5 AS VARCHAR)] AS entries FROM defs), links AS (SELECT id, unnest([id % 10, 10 + id % 3]) AS rule FROM script), used AS (SELECT DISTINCT rule, name FROM links JOIN calls USING (id))"""


def resolved(c: Catalog, whole: bool) -> tuple[DataFrame, DataFrame]:
    used, defined = calls(c)
    defined = defined if whole else undefined(defined)
    links = c.script.select("id", F.explode(F.array(F.col("id") % 10, F.col("id") % 3 + 10)).alias("rule"))
    field = F.when(F.length("name") % 3 == 0, "path").when(F.length("name") % 3 == 1, "process")
    entries = F.array(F.concat("name", F.lit("/a")), F.concat(F.col("name"), F.lit("/"), (F.col("defined_in") % 5).cast("string")))
    return scripts.resolve_rules(links, used, defined.select("name", field.alias("field"), entries.alias("entries")))


@query("m9_resolve_rules", over("script", sql=CALLS + REGISTRY + " SELECT DISTINCT rule, field, unnest(entries) AS value FROM used JOIN reg USING (name) WHERE field IS NOT NULL"))
def m9(c: Catalog) -> DataFrame:
    """The values that each rule's list fields get by the functions that its scripts call."""
    return resolved(c, whole=True)[0]


@query("m9_unmapped_calls", over("script", sql=UNDEFINED + REGISTRY + " SELECT rule, name FROM used WHERE name NOT IN (SELECT name FROM reg)"))
def m9b(c: Catalog) -> DataFrame:
    """Called names that nothing defines are kept as unmapped, not guessed."""
    return resolved(c, whole=False)[1]


@query("j12_change_versions", over("version", sql="SELECT o_orderkey AS key, coalesce(v.version, o_orderpriority) AS shown_version FROM orders LEFT JOIN (SELECT * FROM version WHERE version > '1996') v ON v.version = CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR)"))
def j12(c: Catalog) -> DataFrame:
    by = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    changes = c.read("orders").select(F.col("o_orderkey").alias("key"), by.alias("at"), "o_orderpriority")
    return delta.with_version(changes, c.version.where("version > '1996'"), "at", "o_orderpriority").select("key", "shown_version")


@query("w5_best_definition", "SELECT p_name AS name, p_partkey AS id, p_size AS entries FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r = 1")
def w5(c: Catalog) -> DataFrame:
    return windows.last_wins(c.read("part"), ["p_name"], [F.desc("p_size"), F.asc("p_partkey")]).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.col("p_size").alias("entries"))


@query("w11_group_total", over("entity", sql="SELECT signature_id, count(*) OVER (PARTITION BY family) AS total FROM entity WHERE category = 'SMALL'"))
def w11(c: Catalog) -> DataFrame:
    return c.entity.where("category = 'SMALL'").select("signature_id", F.count(F.lit(1)).over(Window.partitionBy("family")).alias("total"))


@query("a23_selection_by_category", over("entity", sql="SELECT category, array_to_string(list_sort(list(signature_id)), ',') AS ids FROM entity GROUP BY 1"))
def a23(c: Catalog) -> DataFrame:
    return c.entity.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("signature_id")), ",").alias("ids"))


@query("c12_weighted_rules", over("item", sql=", k AS (SELECT owner, ord, size, sig_type, 1 + sig_type % 3 - CASE WHEN size % 5 = 0 THEN 1 ELSE 0 END AS k FROM item), t AS (SELECT *, CAST(k * sig_type + k * (k - 1) / 2 AS INTEGER) AS total FROM k) SELECT owner, ord, CAST(size % 20 AS INTEGER) AS threshold, total, size % 20 = total AS all_required FROM t"))
def c12(c: Catalog) -> DataFrame:
    """Each item as a packed rule of one to three sub-rules, of which the last one is cut off in some, parsed again."""
    little = lambda x: F.concat(F.lpad(F.hex(x % 256), 2, "0"), F.lpad(F.hex(F.floor(x / 256).cast("int")), 2, "0"))
    n = F.col("sig_type") % 3 + 1
    subrules = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(little(F.col("sig_type") + i), F.lit("03414243"))), "")
    text = F.concat(F.lit("0000"), little(F.col("size") % 20), little(n), F.lit("00"), subrules)
    packed = F.unhex(F.when(F.col("size") % 5 == 0, F.substr(text, F.lit(1), F.length(text) - 2)).otherwise(text))
    rules = c.item.select("owner", "ord", records.weighted_rule(packed).alias("rule"))
    total = records.total_weight(F.col("rule"))
    return rules.select("owner", "ord", "rule.threshold", total.alias("total"), (total == F.col("rule.threshold")).alias("all_required"))


#: Runs of printable bytes with their offsets: other characters become as many marks as they have bytes, and texts are split there.
RUNS = r"""x AS (SELECT id, size AS n, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', chr(1), 'g'), '[\x{80}-\x{7ff}]', chr(1) || chr(1), 'g'), '[\x{800}-\x{ffff}]', chr(1) || chr(1) || chr(1), 'g'), '[\x{10000}-\x{10ffff}]', chr(1) || chr(1) || chr(1) || chr(1), 'g'), chr(1)) AS w FROM payload),
    y AS (SELECT id, n, unnest(range(1, len(w) + 1)) AS i, length(unnest(w)) AS l FROM x), r AS (SELECT *, sum(l + 1) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) - l - 1 AS o FROM y)"""


@query("c17_strings_with_context", over("payload", sql=", " + RUNS + " SELECT id, count(*) FILTER (l >= 4) AS strings, CAST(coalesce(sum(o) FILTER (l >= 4), 0) AS BIGINT) AS offsets, CAST(coalesce(sum(least(o + l + 16, n) - greatest(o - 16, 0)) FILTER (l >= 4), 0) AS BIGINT) AS context_bytes FROM r GROUP BY 1"))
def c17(c: Catalog) -> DataFrame:
    """How many strings each item has, and the sums of their offsets and of the bytes shown around them."""
    found = c.payload.select("id", F.explode_outer(records.strings_with_context(F.col("data"))).alias("s"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return found.groupBy("id").agg(F.count("s").alias("strings"), total("s.offset").alias("offsets"), total(F.length("s.context") / 2).alias("context_bytes"))


@query("c19_regions", over("payload", sql=", " + RUNS + " SELECT id, 'string' AS kind, count(*) AS regions, CAST(sum(l) AS BIGINT) AS bytes, CAST(sum(o) AS BIGINT) AS offsets FROM r WHERE l >= 4 GROUP BY 1"))
def c19(c: Catalog) -> DataFrame:
    """Regions of each item by kind; texts begin with no magic bytes and hold no null runs, which fixtures test."""
    found = c.payload.select("id", F.explode(records.regions(F.col("data"))).alias("x"))
    return found.groupBy("id", "x.kind").agg(F.count(F.lit(1)).alias("regions"), F.sum("x.length").cast("long").alias("bytes"), F.sum("x.offset").cast("long").alias("offsets"))


#: Each line of a document as a call that looks for a path, some negated, some followed by a clean return.
FINDS = r"""l AS (SELECT doc_id AS id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    p AS (SELECT id, k, 'c:\' || substring(md5(line), 1, 1) || '\x' AS path, length(line) % 11 = 0 AS negated, length(line) % 7 = 0 AS clean FROM l),
    q AS (SELECT *, bool_or(clean) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS near FROM p)"""


@query("c23_path_context", "WITH " + FINDS + " SELECT id, path, CASE WHEN bool_or(near OR negated) THEN 'exclusion' ELSE 'detection' END AS kind FROM q GROUP BY ALL")
def c23(c: Catalog) -> DataFrame:
    line = lambda s: F.concat(F.when(F.length(s) % 11 == 0, F.lit("if not ")).otherwise("if "), F.lit('p:find("c:\\'), F.substring(F.md5(s), 1, 1), F.lit('\\x") then '), F.when(F.length(s) % 7 == 0, "return mp.CLEAN").when(F.length(s) % 7 == 1, "return mp.INFECTED").otherwise("x = 2"))
    source = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return scripts.path_context(c.read("documents").select(F.col("doc_id").alias("id"), source.alias("source")), "id", "source")


@query("c29_history_payload", over("change", sql="SELECT change_id, entity_id, md5(CAST(to_json({'payload': payload}) AS VARCHAR)) AS payload FROM change"))
def c29(c: Catalog) -> DataFrame:
    return c.change.select(delta.history_payload(["change_id", "entity_id", "payload"], ["payload"]).alias("x")).select("x.*")


@query("c30_classify_by_dictionary", over("payload", sql="SELECT class, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'example.com') THEN 'network' WHEN contains(lower(text), 'that the') THEN 'common' WHEN contains(lower(text), ' und ') THEN 'german' ELSE 'Other' END AS class FROM payload) GROUP BY 1"))
def c30(c: Catalog) -> DataFrame:
    terms = c.spark.createDataFrame([("example.com", 1, "network"), ("that the", 2, "common"), (" und ", 3, "german")], "term string, priority int, class string")
    return classify.classify_by(c.payload.select("text"), "text", terms).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("k6_bundle_export", over("entity", "item", sql="SELECT CAST(position AS INTEGER) AS position, signature_id, '[' || string_agg('{\"ord\":' || ord || ',\"sig_type\":' || sig_type || ',\"size\":' || size || ',\"data\":\"' || lower(hex(encode(sig_type_name || ord))) || '\"}', ',' ORDER BY ord) || ']' AS items FROM (VALUES (7, 0), (3, 1)) v(id, position) JOIN entity ON signature_id = id JOIN item ON owner = id GROUP BY ALL"))
def k6(c: Catalog) -> DataFrame:
    """Entities in the caller's order with their items and the items' bytes."""
    return sinks.bundle_export(c.entity, c.item.withColumn("data", F.encode(F.concat("sig_type_name", F.col("ord").cast("string")), "UTF-8")), [7, 3, 7])


@query("m1_sync", over("snapshot_old", "snapshot_new", sql="SELECT count(*) FILTER (o.key IS NULL) AS added, CAST(0 AS BIGINT) AS removed, count(*) FILTER (o.key IS NOT NULL AND n.key IS NOT NULL AND o.status <> n.status) AS updated, CAST(0 AS BIGINT) AS same FROM snapshot_old o FULL JOIN snapshot_new n USING (key)"))
def m1(c: Catalog) -> DataFrame:
    """An incremental version: nothing is removed, and what stayed the same makes no change."""
    return delta.sync(c.snapshot_old, c.snapshot_new, "key", ["status", "price", "priority"], "next", c.version, full=False)["totals"]


@query("m1_snapshot", over("snapshot_old", "snapshot_new", sql="SELECT key, status, price, priority FROM snapshot_new UNION ALL SELECT key, status, price, priority FROM snapshot_old WHERE key NOT IN (SELECT key FROM snapshot_new)"))
def m1b(c: Catalog) -> DataFrame:
    """The snapshot after the incremental version."""
    return delta.sync(c.snapshot_old, c.snapshot_new, "key", ["status", "price", "priority"], "next", c.version, full=False)["snapshot"]


@query("m1_changes", over("snapshot_old", "snapshot_new", sql="SELECT key, CASE WHEN n.key IS NULL THEN 'removed' WHEN o.key IS NULL THEN 'added' ELSE 'updated' END AS change, CASE WHEN o.status <> n.status THEN 'status: ' || o.status || ' -> ' || n.status ELSE '' END AS status_change, 'full' AS version FROM snapshot_old o FULL JOIN snapshot_new n USING (key) WHERE o.key IS NULL OR n.key IS NULL OR o.status <> n.status"))
def m1c(c: Catalog) -> DataFrame:
    """The change feed of a full version: removed keys too, and what changed in words."""
    changes = delta.sync(c.snapshot_old, c.snapshot_new, "key", ["status", "price", "priority"], "full", c.version, full=True)["changes"]
    updated = F.when(F.col("change") == "updated", F.col("summary")).otherwise("")
    return changes.select("key", "change", updated.alias("status_change"), "version")


@query("m1_versions", over("version", sql="SELECT version, false AS is_current FROM version UNION ALL SELECT 'next', true"))
def m1d(c: Catalog) -> DataFrame:
    """The versions after publishing, of which the new one is current."""
    return delta.sync(c.snapshot_old, c.snapshot_new, "key", ["status"], "next", c.version, full=True)["versions"]


@query("m5_store_pairs", over("rule_value", sql=PAIRS + " SELECT a, b, score, 'values' AS kind FROM s WHERE score >= 0.6"))
def m5(c: Catalog) -> DataFrame:
    pairs = similarity.set_similarity(tagged_values(c), "guid", "value", 0.6)
    return similarity.store_pairs(pairs, "values", once=True)


@query("m12_exclusion_review", over("script", sql=PATHS + r" SELECT count(*) FILTER (id % 6 IN (3, 4)) AS low, count(*) FILTER (id % 6 IN (2, 5)) AS medium, count(*) FILTER (id % 6 = 0) AS high, count(*) FILTER (id % 6 = 1) AS critical, 'critical' AS overall FROM v"))
def m12(c: Catalog) -> DataFrame:
    return aggregates.risk_summary(paths(c).select(risk.path_risk(F.col("path"))["level"].alias("level")))


@query("m13_relink", "SELECT guid, count(*) AS scripts FROM (SELECT DISTINCT conv_id, turn, unnest(list_filter(['11', '22', CAST(turn AS VARCHAR)], lambda g: g = CAST(turn AS VARCHAR) OR (g = '11' AND contains(lower(text), 'and the')) OR (g = '22' AND contains(lower(text), 'de la')))) AS guid FROM conversations) GROUP BY 1")
def m13(c: Catalog) -> DataFrame:
    """Links are added to those a script has, never removed, and rules are counted anew."""
    linked = F.array_union(F.array(F.col("turn").cast("string")), scripts.link_rules(F.col("text"), {"and the": "11", "de la": "22"}))
    return c.read("conversations").select(F.explode(linked).alias("guid")).groupBy("guid").agg(F.count(F.lit(1)).alias("scripts"))


@query("m14_catalog_status", "SELECT o_custkey % 50 AS catalog, CASE WHEN count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 400000) > 0 THEN 'running' WHEN max_by(o_orderstatus, o_orderkey) = 'F' THEN 'failed' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'ready' ELSE 'initializing' END AS status FROM orders GROUP BY 1")
def m14(c: Catalog) -> DataFrame:
    running = F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400_000))
    runs = c.read("orders").groupBy((F.col("o_custkey") % 50).alias("catalog")).agg(running.alias("running"), F.max_by("o_orderstatus", "o_orderkey").alias("last"), F.count_if(F.col("o_orderstatus") == "O").alias("done"))
    status = F.when(F.col("running") > 0, "running").when(F.col("last") == "F", "failed").when(F.col("done") > 0, "ready").otherwise("initializing")
    return runs.select("catalog", status.alias("status"))


#: Leading bytes by the length of a text, and eight nulls behind every third: items of all kinds of content.
HEADS = "hd(k, hex, name, joins) AS (VALUES " + ", ".join(f"({k}, '{h}', '{n}', {0x20 <= int(h[-2:], 16) <= 0x7E})" for k, (h, n) in enumerate(text.MAGIC)) + f", ({len(text.MAGIC)}, '', NULL, false))"
MADE = HEADS + f", it AS (SELECT doc_id AS id, doc_id % 97 AS owner, text, hex, name, joins, strlen(text) % 3 = 0 AS nulls, strlen(text) + length(hex) // 2 + CASE WHEN strlen(text) % 3 = 0 THEN 8 ELSE 0 END AS size FROM documents JOIN hd ON k = strlen(text) % {len(text.MAGIC) + 1})"


def made_items(c: Catalog) -> DataFrame:
    n = F.octet_length("text")
    head = F.element_at(F.array(*(F.lit(bytes.fromhex(h)) for h, _ in text.MAGIC), F.lit(b"")), n % (len(text.MAGIC) + 1) + 1)
    tail = F.when(n % 3 == 0, F.lit(bytes(8))).otherwise(F.lit(b""))
    return c.read("documents").select(F.col("doc_id").alias("id"), F.pmod("doc_id", F.lit(97)).alias("owner"), F.concat(head, F.encode("text", "UTF-8"), tail).alias("data"))


@query("c15_magic", "WITH " + MADE + " SELECT id, coalesce(name, '') AS magic FROM it")
def c15(c: Catalog) -> DataFrame:
    """All signatures occur, by the length of texts, and none."""
    return made_items(c).select("id", F.array_join(text.magic(F.col("data")), ",").alias("magic"))


@query("m16_entity_profile", "WITH " + MADE + r""", bt AS (SELECT id, owner, size, unnest(regexp_extract_all(hex || hex(encode(text)) || CASE WHEN nulls THEN repeat('00', 8) ELSE '' END, '..')) AS b FROM it),
    en AS (SELECT id, owner, abs(round(-sum(k / size * log2(k / size)), 4)) AS e FROM (SELECT id, owner, size, b, count(*) AS k FROM bt GROUP BY ALL) GROUP BY ALL),
    st AS (SELECT id, owner, regexp_extract_all(CASE WHEN joins THEN regexp_replace(text, '^[\x20-\x7e]+', '') ELSE text END, '[\x20-\x7e]{4,}') AS x FROM it),
    sr AS (SELECT owner, CAST(sum(len(x)) AS BIGINT) AS string_regions, CAST(sum(list_sum(list_transform(x, lambda s: length(s)))) AS BIGINT) AS string_bytes FROM st GROUP BY 1),
    te(term) AS (VALUES ('ing of'), ('that the'), ('de la'), ('example.com')), hi AS (SELECT owner, term, (length(text) - length(replace(text, term, ''))) // length(term) AS n FROM it, te WHERE contains(text, term)),
    hs AS (SELECT owner, CAST(sum(n) AS BIGINT) AS hits, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM hi GROUP BY 1)
    SELECT owner, items, least_entropy, most_entropy, size, magic_regions, magic_bytes, null_regions, null_bytes, coalesce(string_regions, 0) AS string_regions, coalesce(string_bytes, 0) AS string_bytes, coalesce(hits, 0) AS hits, coalesce(terms, '') AS terms, coalesce(magic, '') AS magic
    FROM (SELECT owner, count(*) AS items, CAST(sum(size) AS BIGINT) AS size, count(name) AS magic_regions, CAST(sum(length(hex) // 2) AS BIGINT) AS magic_bytes, count(*) FILTER (nulls) AS null_regions, count(*) FILTER (nulls) * 8 AS null_bytes, string_agg(DISTINCT name, ',' ORDER BY name) AS magic FROM it GROUP BY 1)
    JOIN (SELECT owner, min(e) AS least_entropy, max(e) AS most_entropy FROM en GROUP BY 1) USING (owner) LEFT JOIN sr USING (owner) LEFT JOIN hs USING (owner)""")
def m16(c: Catalog) -> DataFrame:
    """What the bytes of each entity's items are made of: entropies, magic, regions and hits of terms."""
    terms = c.spark.createDataFrame([(t[0],) for t in TERMS], "term string")
    found = profiles.entity_profiles(made_items(c), terms)
    return found.withColumns({k: F.array_join(k, ",") for k in ("terms", "magic")})


@query("m17_standalone_grouping", """
    WITH m AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'signup' THEN 'b' WHEN 'error' THEN 'e' END AS mark FROM events),
    n AS (SELECT *, first_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next,
      last_value(CASE WHEN mark IS NOT NULL THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at FROM m)
    SELECT n.event_type AS kind, count(*) AS n FROM n LEFT JOIN n b ON b.event_id = n.at WHERE n.mark IS NULL AND NOT coalesce(b.mark = 'b' AND b.next = 'e', false) GROUP BY 1""")
def m17(c: Catalog) -> DataFrame:
    rows = c.read("events").select(F.col("user_id").alias("path"), F.col("event_id").alias("offset"), "event_type")
    begin, end = F.col("event_type") == "signup", F.col("event_type") == "error"
    outside = windows.assign_blocks(rows, begin, end).where(F.col("block").isNull() & ~begin & ~end)
    return outside.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
