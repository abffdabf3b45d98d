"""Operators on small hand-made tables: the scenarios of the catalog and the corners that SQL oracles don't reach."""

import pytest
from pyspark.sql import functions as F

from detectlake.functions import classify, naming, records, risk, scripts, text
from detectlake.operators import aggregates, delta, dictionary, filters, paging, similarity, windows
from detectlake.sources import readers, sinks
from detectlake.streaming import jobs
from detectlake.streaming.snapshots import Snapshot


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame([(1001, "Demo:Alpha", "Demo", "Alpha", 1), (1002, "Demo:Beta", "Other", "Beta", 1)], "signature_id long, threat_name string, category string, family string, signature_count int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1001, 1, 1, "STRING", 5, bytearray(b"alpha")), (1002, 2, 2, "BINARY", 4, bytearray(b"beta"))], "owner long, ord long, sig_type int, sig_type_name string, size int, data binary")


@pytest.mark.parametrize(
    ("field", "op", "value", "want"),
    [
        ("category", "equals", "other", [1002]),
        ("name", "not_contains", "ALPHA", [1002]),
        ("family", "starts_with", "Al", [1001]),
        ("family", "ends_with", "ta", [1002]),
        ("signature_type", "equals", "string", [1001]),
        ("signature_type", "not_contains", "STRING", [1002]),
    ],
)
def test_filters_and_query(entities, items, field, op, value, want):
    found = filters.search_entities(entities, items, [{"field": field, "op": op, "value": value}], q="Demo")
    assert sorted(r.signature_id for r in found.collect()) == want
    assert filters.search_entities(entities, items, [{"field": "category", "op": "equals", "value": "Other"}], q="Alpha").count() == 0


@pytest.mark.parametrize("bad", ["{", '[{"field":"x","op":"equals","value":"a"}]', '[{"field":"name","op":"like","value":"a"}]', '[{"field":"name","op":"equals","value":" "}]', "[" + ",".join(['{"field":"name","op":"equals","value":"a"}'] * 21) + "]"])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        filters.parse_filters(bad)


def test_wildcards_stand_for_themselves(spark):
    df = spark.createDataFrame([("100%",), ("100x",), ("a_b",), ("axb",), ("back\\slash",), (None,)], "s string")
    hit = lambda q: sorted(r.s for r in df.where(filters.icontains("s", q)).collect())
    assert hit("0%") == ["100%"] and hit("A_B") == ["a_b"] and hit("k\\s") == ["back\\slash"]
    assert df.where(filters.text_predicate("s", "not_contains", "a")).count() == 3


def test_export(entities, items, spark):
    got = sinks.bundle_export(entities, items, [1002, 1001, 1002]).collect()
    assert [r.signature_id for r in got] == [1002, 1001] and '"size":4' in got[0]['items']
    with pytest.raises(KeyError):
        sinks.bundle_export(entities, items, [1001, 7])
    many = spark.range(5_001).select(F.lit(1001).cast("long").alias("owner"), F.col("id").alias("ord"), F.lit(1).alias("sig_type"), F.lit(1).alias("size"))
    with pytest.raises(ValueError):
        sinks.bundle_export(entities, many, [1001])


def test_family_pages(spark):
    df = spark.range(105).select(F.concat(F.lit("Family"), F.col("id").cast("string")).alias("family"), F.lit("Demo").alias("category"))
    page = paging.family_page(df, None, "Demo", 5, 25).collect()
    assert len(page) == 5 and {r.total for r in page} == {105} and {r.pages for r in page} == {5}
    assert [r.family for r in paging.family_page(df, "104", None, 1, 25).collect()] == ["Family104"]
    whole = [r.family for n in range(1, 6) for r in paging.family_page(df, None, None, n, 25).collect()]
    assert sorted(whole) == sorted(r.family for r in df.collect())


def test_cap_keeps_every_group(spark):
    rows = [(e, e * 100 + i) for e in range(30) for i in range(20)]
    got = windows.representative_selection(spark.createDataFrame(rows, "owner long, ord long"), "owner", "ord", 500).collect()
    assert len(got) == 500 and len({r.owner for r in got}) == 30
    with pytest.raises(ValueError, match="more than 29 groups"):
        windows.representative_selection(spark.createDataFrame(rows, "owner long, ord long"), "owner", "ord", 29)
    same = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (None, None, "c"), (2, 7, "d")], "owner long, ord long, x string")
    assert [(r.owner, r.x) for r in windows.representative_selection(same, "owner", "ord", 3).collect()] == [(None, "c"), (1, "a"), (2, "d")]


def test_history(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0)], "key long, family string, price double")
    new = spark.createDataFrame([(1, "a", 1.0), (2, "c", 2.0), (4, "d", 4.0), (3, "x", 3.0)], "key long, family string, price double")
    got = {r.key: r for r in delta.changes_between(old, new, "key", ["family", "price"], "v2").collect()}
    assert set(got) == {2, 3, 4} and got[2].summary == "family: b -> c" and got[3].summary == "family added: x" and got[4].change == "added"
    known = spark.createDataFrame([("v1",)], "version string")
    made = delta.sync(old, new, "key", ["family", "price"], "v2", known, full=False)
    assert made["snapshot"].count() == 4 and tuple(made["totals"].first()) == (1, 0, 2, 0)
    assert delta.sync(old, new, "key", ["family"], "v1", known, full=True) == {}
    with pytest.raises(ValueError):
        delta.sync(old, new.where("key < 0"), "key", ["family"], "v3", known, full=True)


def test_result_of_changed_input_is_not_published(spark, tmp_path):
    """Inputs are read anew for each batch; the last result of an id counts."""
    results = spark.createDataFrame([(1, "h1", "out"), (2, "old", "out"), (3, "h3", "out")], "id long, content_hash string, result string")
    inputs = spark.createDataFrame([(1, "h1", "pending"), (2, "new", "pending"), (3, "h3", "done")], "id long, content_hash string, status string")
    later = spark.createDataFrame([(1, "h9", "pending"), (2, "new", "pending")], inputs.schema)
    now = [inputs]
    for rows in (results, spark.createDataFrame([(1, "h1", "late"), (2, "new", "again")], results.schema)):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.file_stream(spark, f"{tmp_path}/in", results.schema)
        assert jobs.publish_unchanged(stream, f"{tmp_path}/work", lambda: now[0]).awaitTermination(120)
        now[0] = later
    assert {(r.id, r.result) for r in jobs.published(spark, f"{tmp_path}/work").collect()} == {(1, "out"), (2, "again")}


def record(kind, payload):
    return bytes([kind, len(payload) & 255]) + (len(payload) >> 8).to_bytes(2, "little") + payload


HEAD = (77).to_bytes(4, "little") + b"\0" * 6 + bytes([10]) + b"\0\0" + b"Demo:Alpha"


def test_records():
    data = record(1, b"x" * 300) + record(2, b"") + record(3, b"abc")
    got = list(readers.records_of(data + b"\x05\xff\xff\xff"))
    assert [(t, s, o) for t, s, _, o in got] == [(1, 300, 0), (2, 0, 304), (3, 3, 308)] and got[0][2] == b"x" * 300
    assert list(readers.records_of(b"")) == []


def test_ingest(spark, tmp_path):
    whole = record(9, b"out") + record(0x5C, HEAD) + record(1, b"in1") + record(2, b"in2") + record(0x5D, b"") + record(3, b"after") + record(0x5C, b"cut") + record(4, b"open")
    (tmp_path / "a.bin").write_bytes(whole)
    (tmp_path / "empty.bin").write_bytes(b"")
    got = {r.sig_type: r for r in records.ingest(readers.read_records(spark, str(tmp_path)), {1: "REGKEY", 2: "BLAHHSTR"}, {"REGKEY": ("Persistence/Registry", "Run")}, ("REGKEY",)).collect()}
    assert set(got) == {9, 1, 2, 3, 4}
    assert got[1].owner == got[2].owner == 77 and got[1].owner_name == "Demo:Alpha"
    assert got[9].owner is None and got[3].owner is None and got[4].owner is None
    assert got[1].family == "Alpha" and tuple(got[1]["class"]) == ("Persistence/Registry", "Run") and got[1].searchable == "in1"
    assert tuple(got[2]["class"]) == ("Other/Strings", None) and got[2].searchable == "" and tuple(got[9]["class"]) == ("Unknown", None)
    listed = readers.list_sources(spark, str(tmp_path)).collect()
    assert {r.files for r in listed} == {1} and {r.bytes for r in listed} == {len(whole)}


def test_weighted_rules(spark):
    sub = lambda w, b: w.to_bytes(2, "little") + bytes([len(b)]) + b
    good = b"\0\0" + (5).to_bytes(2, "little") + (2).to_bytes(2, "little") + b"\0" + sub(2, b"abc") + sub(3, b"\x90\x01\x41\x90\x00")
    rows = [(1, bytearray(good)), (2, bytearray(good[:-2])), (3, bytearray(b"x")), (4, None)]
    df = spark.createDataFrame(rows, "id long, data binary").withColumn("rule", records.weighted_rule(F.col("data")))
    got = {r.id: r for r in df.select("id", "rule", records.total_weight(F.col("rule")).alias("total")).collect()}
    assert got[1].rule.threshold == 5 and got[1].total == 5 and got[2].total == 2 and got[3].rule is None and got[4].rule is None
    codes = df.where("id = 1").select(records.wildcards(F.col("rule.subrules")[1]["bytes"])).first()[0]
    assert codes == ["any {n}", "end"]


def test_digest_lists(spark):
    packed = bytes(range(1, 33)) + bytes(32) + bytes(range(32, 64))
    got = spark.createDataFrame([(bytearray(packed), "SHA256"), (bytearray(packed), None), (bytearray(packed[:16]), "MD5"), (bytearray(b""), "MD5")], "d binary, k string").select(records.hash_list(F.col("d"), F.col("k")).alias("h")).collect()
    assert got[0].h == [packed[:32].hex(), packed[64:].hex()] and got[1].h == got[0].h and got[2].h == [packed[:16].hex()] and got[3].h == []


def test_bytes(spark):
    data = b"MZ\x00\x00" + b"strings" + b"\x00" * 9 + b"\xe9t\xe9" + b"end!" + b"\x00" * 8
    df = spark.createDataFrame([(bytearray(data),)], "d binary")
    r = df.select(text.printable_runs(F.col("d"), 4).alias("runs"), text.magic(F.col("d")).alias("magic"), records.strings_with_context(F.col("d")).alias("ctx"), text.hex_dump(F.col("d")).alias("dump"), text.pattern_literal(F.col("d"), 4).alias("lit")).first()
    assert r.runs == ["strings", "end!"] and r.magic == ["PE/DOS Executable"] and r.lit == "{ 4D 5A 00 00 }"
    assert [(x.text, x.offset) for x in r.ctx] == [("strings", 4), ("end!", 23)] and bytes.fromhex(r.ctx[0].context) == data[0:27]
    assert r.dump.splitlines()[0] == "00000000  4D 5A 00 00 73 74 72 69 6E 67 73 00 00 00 00 00  MZ..strings....."
    kinds = [tuple(x) for x in df.select(records.regions(F.col("d"), (b"ring",))).first()[0]]
    assert df.select(records.regions(F.lit(None).cast("binary"))).first()[0] is None
    assert kinds == [("magic", 0, 2), ("pattern", 6, 4), ("null", 11, 9), ("string", 23, 4), ("null", 27, 8)]


def test_overlapping_hits(spark):
    got = spark.createDataFrame([("aaaa.b",)], "s string").select(text.pattern_hits(F.col("s"), ("aa", ".b")).alias("x")).first().x
    assert [(h.term, h.offset) for h in got] == [("aa", 0), ("aa", 1), ("aa", 2), (".b", 4)]


def test_names(spark):
    names = ["rojan:Win32/Foo.A", "Trojan:Win32/Foo.B!x", "\x01\x02Worm:X", "plain", "A:b:c/d", "UAlike:Z", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    fixed = [r[0] for r in df.select(naming.fix_name(F.col("n"))).collect()]
    assert fixed == ["Trojan:Win32/Foo.A", "Trojan:Win32/Foo.B!x", "Worm:X", "plain", "A:b:c/d", "UAlike:Z", ""]
    parsed = [tuple(r[0]) for r in df.select(naming.parse_name(F.col("n"))).collect()]
    assert parsed[0] == ("Trojan", "Win32") and parsed[3] == ("plain", "Unknown") and parsed[4] == ("A", "b:c")
    other = [tuple(r[0]) for r in df.select(naming.name_taxonomy(F.col("n"), "platform")).collect()]
    assert other[1] == ("Trojan.Win32", "Foo")
    ids = [r[0] for r in spark.createDataFrame([("9 a-b",), ("",), ("x" * 200,)], "n string").select(naming.rule_identifier(F.col("n"))).collect()]
    assert ids == ["_9_a_b", "unnamed_rule", "x" * 128]


def test_risk(spark):
    paths = ["*", "C:\\Users\\a\\x", "c:\\windows\\x", "x.log", "plain", "c:\\users\\public\\*.exe"]
    got = [r.r for r in spark.createDataFrame([(p,) for p in paths], "p string").select(risk.path_risk(F.col("p"), (("wildcard_exe", r"\*\.(exe|dll)", "T1059"),)).alias("r")).collect()]
    assert [r.level for r in got] == ["critical", "high", "medium", "low", "low", "critical"]
    assert got[4].reasons == [risk.NO_RISK] and [s.name for s in got[5].scenarios] == ["wildcard_exe"]
    rated = spark.createDataFrame([("low",), ("high",), ("high",)], "level string")
    assert aggregates.risk_summary(rated).first().asDict() == {"low": 1, "medium": 0, "high": 2, "critical": 0, "overall": "high"}


def test_a_rule_does_not_overlap_with_itself(spark):
    rows = [("r1", "f", "C:\\A"), ("r1", "f", "c:\\a "), ("r2", "f", "x"), ("r3", "f", "X")]
    got = aggregates.shared_values(spark.createDataFrame(rows, "guid string, field string, value string")).collect()
    assert sorted((r.value, r.guid, r.rules) for r in got) == [("x", "r2", 2), ("x", "r3", 2)]


TYPES = {"REGKEY": ("Persistence/Registry", None), "FILENAME": ("Persistence/FilePath", None), "FRIENDLYHASH_SHA1": ("Hash/Friendly", "SHA1")}
PARTS = {"Persistence/Registry": ((r"CurrentVersion\\Run", "Run"), (r"Services\\", "Services")), "Persistence/FilePath": ((r"\\Temp\\", "Temp"),)}


def test_large_dictionary(spark):
    """The first entry by priority wins, wherever its term stands, whether a dictionary is sent to tasks or dealt to shards."""
    terms = spark.createDataFrame([("upx packed", 2, "packer"), ("nsis", 1, "installer"), ("Upx", 3, "other"), ("evil", 4, "bad"), (None, 0, "none"), ("", 0, "none")], "term string, priority int, class string")
    more = terms.unionByName(spark.range(1500).selectExpr("concat('unseen term ', id) AS term", "9 AS priority", "'x' AS class"))
    rows = spark.createDataFrame([(1, "a UPX packed nsis"), (2, "some upx packed"), (3, "upx"), (4, "none"), (5, None), (3, "upx"), (6, "xxevilyy"), (7, "")], "id long, s string")
    for entries in (terms, more):
        for sizes in ({}, {"sent": 0, "shard": 40, "group": 20}):
            got = sorted((r.id, r["class"]) for r in dictionary.first_class(rows, "s", entries, "class", "Other", **sizes).collect())
            assert got == [(1, "installer"), (2, "packer"), (3, "other"), (3, "other"), (4, "Other"), (5, "Other"), (6, "bad"), (7, "Other")]
    assert [r["class"] for r in classify.classify_by(rows.where("id = 6"), "s", more).collect()] == ["bad"]


def test_classify(spark):
    rows = [("SIGNATURE_TYPE_REGKEY", "Software\\x\\CurrentVersion\\RunOnce"), ("FILENAME", "c:\\Temp\\a"), ("BLAHHSTR", ""), (None, ""), ("FRIENDLYHASH_SHA1", "")]
    got = [tuple(r.c) for r in spark.createDataFrame(rows, "t string, x string").select(classify.type_category(F.col("t"), F.col("x"), TYPES, PARTS).alias("c")).collect()]
    assert got == [("Persistence/Registry", "Run"), ("Persistence/FilePath", "Temp"), ("Other/Strings", None), ("Unknown", None), ("Hash/Friendly", "SHA1")]
    terms = spark.createDataFrame([("UPX", 1, "packer"), ("nsis", 2, "installer")], "term string, priority int, class string")
    own = classify.classify_by(spark.createDataFrame([("a upx! nsis",), ("NSIS",), ("none",)], "s string"), "s", terms)
    assert [r["class"] for r in own.collect()] == ["packer", "installer", "Other"]


SOURCE = """function IsKnownTool(a)
  local t = {}
  t["one"] = 1
  if a then for i = 1, 2 do x(i) end end
  return {'two', 'three'}
end
-- function commented() end
local function helper() return "end" end
if string.find(p, "\\\\good\\\\dir\\\\", 1, true) then
  return mp.CLEAN
end










if q:find("\\\\bad\\\\tool.exe", 1, true) then
  mp.set_mpattribute("x")
  return mp.INFECTED
end
local g = "be9ba2d9-53ea-4cdc-84e5-9b1eeee46550" local m = 'T1059.001'
os.execute("x") debug.x()
"""


def test_scripts(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, "nothing"), (3, None)], "id long, source string")
    bodies = {r.name: r for r in scripts.function_bodies(df, "id", "source").collect()}
    assert set(bodies) == {"IsKnownTool", "helper"} and bodies["IsKnownTool"].entries == ["one", "two", "three"]
    kinds = {r.path: r.kind for r in scripts.path_context(df, "id", "source").collect()}
    assert kinds == {"\\\\good\\\\dir\\\\": "exclusion", "\\\\bad\\\\tool.exe": "detection"}
    row = df.where("id = 1").select(scripts.extracted(F.col("source"), "guids").alias("g"), scripts.techniques(F.col("source")).alias("t"), scripts.script_logic(F.col("source"), {"path": r"string\.find|:find\(", "file": "readfile"}, {"infected": r"mp\.INFECTED", "clean": r"mp\.CLEAN", "attribute": "set_mpattribute"}).alias("l"), scripts.script_risk(F.col("source"), ((30, r"os\.execute"), (10, r"debug\.\w+"))).alias("r"), scripts.link_rules(F.col("source"), {"Known": "AA"}).alias("links")).first()
    assert row.g == ["be9ba2d9-53ea-4cdc-84e5-9b1eeee46550"] and row.t == ["T1059.001"] and row.r == 40
    assert row.l.entry == "IsKnownTool" and row.l.trigger == "path" and row.l.flow == ["check path", "outcome clean", "outcome attribute", "outcome infected"]
    assert row.l.kind == "detection" and set(row.l.outcomes) == {"infected", "clean", "attribute"} and row.links == ["aa", row.g[0]]
    defs = spark.createDataFrame([(1, "f", ["a"], "x"), (2, "f", ["b", "c"], "y"), (3, "f", ["d"], "z")], "id long, name string, entries array<string>, body string")
    assert [scripts.best_definitions(defs, p).first().entries for p in ("most", "last", "union")] == [["b", "c"], ["d"], ["a", "b", "c", "d"]]


def test_similarity(spark):
    sets = [(1, v) for v in "abcdef"] + [(2, v) for v in "abcdeg"] + [(3, v) for v in "xyz"] + [(4, v) for v in "abcdef"]
    got = {(r.a, r.b): r.score for r in similarity.set_similarity(spark.createDataFrame(sets, "k long, v string"), "k", "v", 0.7).collect()}
    assert got == {(1, 2): 0.7143, (1, 4): 1.0}  # 4 is as 1: it has no pairs of its own
    left = spark.createDataFrame([(1, bytearray(b"0123456789abcdef")), (9, None), (8, bytearray(b"short"))], "id long, t binary")
    right = spark.createDataFrame([(2, bytearray(b"xx0123456789yy abcdef")), (3, bytearray(b"nothing here at all")), (4, bytearray(b"0123456789" + b"-" * 40)), (5, None)], "id long, t binary")
    found = lambda band: sorted((r.a, r.b, r.covered, round(r.share, 3)) for r in similarity.byte_overlap(left, right, "id", "t", band).collect())
    assert found(True) == [(1, 2, 10, 0.625)] and found(False) == [(1, 2, 10, 0.625), (1, 4, 10, 0.625)]
    tiers = [spark.createDataFrame([(1, 2, 1.0, "hash")], "a long, b long, score double, kind string"), spark.createDataFrame([(2, 1, 0.5, "text"), (1, 3, 0.4, "text")], "a long, b long, score double, kind string")]
    assert {(r.a, r.b, r.kind) for r in similarity.related(tiers, 5).collect()} == {(1, 2, "hash"), (2, 1, "hash"), (1, 3, "text"), (3, 1, "text")}


def test_related_entities(spark):
    """Each tier finds its own: equal data, strings within a family only, bytes for what is asked for."""
    data = {1: b"same payload here", 2: b"same payload here", 3: b"other things 1", 4: b"some more of it", 5: b"prefix of a long body", 6: b"prefix of a long Body"}
    items = spark.createDataFrame([(i, "f" if i < 5 else "g", bytearray(d), str(hash(d))) for i, d in data.items()] + [(7, "f", None, None)], "id long, family string, data binary, data_hash string")
    strings = spark.createDataFrame([(i, "f", s) for i in (3, 4) for s in ("x", "y", f"own{i}")] + [(5, "g", s) for s in ("x", "y")] + [(7, "f", "z")], "id long, family string, string string")
    got = {(r.a, r.b): (r.kind, r.score) for r in similarity.related_entities(items, strings, items.where("id = 5"), 5).collect() if r.a < r.b}
    assert got == {(1, 2): ("hash", 1.0), (3, 4): ("strings", 0.5), (5, 6): ("bytes", round(17 / 21 / 2, 4))}


def test_pairs_of_a_hot_value_in_blocks(spark):
    rows = [("f", "hot", i) for i in range(40)] + [("f", f"own{i % 7}", i) for i in range(40)] + [("f", "hot", 0)]
    df = spark.createDataFrame(rows, "field string, value string, guid long")
    want = {(a, b, 1 + (a % 7 == b % 7)) for a in range(40) for b in range(a + 1, 40)}
    for block in (3, 512):
        assert {tuple(r) for r in similarity.shared_between(df, 1, block).collect()} == want


def test_size_bands(spark):
    sizes = [0, 0, 1, 2, 3, 5, 8, 8, 13, 100, 201]
    got = {r.id: r.partners for r in similarity.size_band_counts(spark.createDataFrame(list(enumerate(sizes)), "id long, size int"), "id", "size").collect()}
    assert got == {i: sum(s // 2 <= t <= 2 * s for t in sizes) - 1 for i, s in enumerate(sizes)}


def test_keys_that_no_table_can_hold(entities):
    find = lambda q: sorted(r.signature_id for r in entities.where(filters.name_or_id("threat_name", "signature_id", q)).collect())
    assert find("1001") == find("0x3E9") == find(" +1001 ") == [1001] and find("demo") == [1001, 1002]
    assert find("9" * 40) == find("0x" + "f" * 20) == find("9223372036854775808") == find("-1001") == find("%") == []


def test_sinks(spark, tmp_path, items):
    sinks.write_record_csv(items.select(F.col("owner").alias("threat_id"), F.lit('a "q", b').alias("threat_name"), "sig_type", "sig_type_name", "size", F.lit(0).cast("long").alias("offset"), F.lit("True").alias("is_lua"), "data"), f"{tmp_path}/csv", most=4)
    back = readers.read_record_csv(spark, f"{tmp_path}/csv").orderBy("threat_id").collect()
    assert back[0].threat_name == 'a "q", b' and back[0].is_lua and back[0].hex_data == "616c..."
    found = spark.createDataFrame([("ip", "1.1.1.1", 1), ("ip", "1.1.1.1", 2), ("url", "http://x", 1)], "kind string, value string, owner long")
    counts = {r.kind: r.n for r in sinks.write_indicator_lists(found, f"{tmp_path}/lists").collect()}
    assert counts == {"ip": 1, "url": 1} and spark.read.text(f"{tmp_path}/lists").count() == 2
    sinks.write_partitioned(items.select("owner", "sig_type_name"), f"{tmp_path}/parts", ["sig_type_name"])
    assert spark.read.parquet(f"{tmp_path}/parts").count() == 2
    sinks.write_rules(spark.createDataFrame([("c", "rule a"), ("c", "rule b")], "category string, rule_text string"), f"{tmp_path}/rules")
    assert spark.read.text(f"{tmp_path}/rules").where("value <> ''").count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.lua").write_text("x\x13y")
    (tmp_path / "s" / "blank.lua").write_text(" \n ")
    assert [r.source for r in readers.read_scripts(spark, str(tmp_path / "s")).collect()] == ["xy"]
    place = tmp_path / "l" / "Trojan" / "Foo"
    place.mkdir(parents=True)
    (place / "combined.sig").write_text("Threat ID: 42\nThreat Name: Trojan:Win32/Foo\nSignatures: 3\n")
    other = tmp_path / "l" / "Worm" / "Bar"
    other.mkdir(parents=True)
    (other / "combined.sig").write_text("no header")
    got = {r.family: r for r in readers.read_entity_listing(spark, str(tmp_path / "l")).collect()}
    assert got["Foo"].signature_id == 42 and got["Foo"].signature_count == 3 and got["Bar"].threat_name == "Worm/Bar"


def test_streams_end_as_batches(spark, tmp_path):
    changes = spark.createDataFrame([("a", i % 3, f"2024-01-0{1 + i % 4} 10:00:00") for i in range(40)], "entity_type string, entity_id long, at string").withColumn("changed_at", F.to_timestamp("at")).drop("at")
    changes.repartition(3).write.parquet(f"{tmp_path}/changes")
    stream = lambda: jobs.file_stream(spark, f"{tmp_path}/changes", changes.schema, 1)
    daily = {(str(r.day), r.n) for r in jobs.run_to_files(jobs.daily_counts(stream(), late=None), "update", ["day"])[0].collect()}
    assert daily == {(str(r.day), r.n) for r in aggregates.daily_activity(changes).collect()}
    state = {(r.entity_id, r.n) for r in jobs.run_to_files(jobs.entity_state(stream()), "update", ["entity_type", "entity_id"])[0].collect()}
    assert state == {(0, 14), (1, 13), (2, 13)}


def test_streamed_results_lie_in_files(spark, tmp_path):
    """Results of streams are Parquet files of their batches, beside the checkpoint; none without input."""
    changes = spark.createDataFrame([("a", i % 3, f"2024-01-0{1 + i % 4} 10:00:00") for i in range(40)], "entity_type string, entity_id long, at string").withColumn("changed_at", F.to_timestamp("at")).drop("at")
    changes.repartition(3).write.parquet(f"{tmp_path}/changes")
    changes.where("entity_id > 5").write.parquet(f"{tmp_path}/none")
    keys = ["entity_type", "entity_id"]
    state, _ = jobs.run_to_files(jobs.entity_state(jobs.file_stream(spark, f"{tmp_path}/changes", changes.schema, 1)), "update", keys)
    assert {(r.entity_id, r.n) for r in state.collect()} == {(0, 14), (1, 13), (2, 13)}
    assert {f.split("/out/")[1].split("/")[0] for f in state.inputFiles()} == {"0", "1", "2"}
    assert jobs.run_to_files(jobs.entity_state(jobs.file_stream(spark, f"{tmp_path}/none", changes.schema)), "update", keys)[0].count() == 0


def test_late_rows_are_counted(spark, tmp_path):
    rows = lambda *days: spark.createDataFrame([(f"2024-01-{d:02} 10:00:00",) for d in days], "at string").select(F.to_timestamp("at").alias("changed_at")).coalesce(1)
    for days in ((1, 9, 10), (11, 11), (2, 11, 12)):
        rows(*days).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", rows(1).schema, 1)
    with jobs.LateRows(spark) as late:
        daily, query = jobs.run_to_files(jobs.daily_counts(stream), "update", ["day"])
        dropped = late.of(query)
    assert {(r.day.day, r.n) for r in daily.collect()} == {(1, 1), (9, 1), (10, 1), (11, 3), (12, 1)}
    assert dropped == 1


def test_streamed_queries_hold_nothing_in_the_driver(spark):
    from detectlake.plans import feeds, registry  # noqa: F401

    for name in ("r3_streamed_daily_counts", "r5_streamed_entity_state"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()


def test_rule_corpus_sorts_no_rule_in_one_task(spark):
    """Numbers follow the ids of each rule, and rows are numbered in ranges of a rule only."""
    ids = [None, *range(-500, 500), 10**12]
    rows = [(i, ["r", f"s{(i or 0) % 2}", None], "x") for i in ids]
    scripts = spark.createDataFrame(rows, "id long, rules array<string>, source string").repartition(5)
    made = sinks.rule_corpus(scripts, "rules")
    want = set()
    for rule in ("r", "s0", "s1", None):
        own = sorted((i for i, rules, _ in rows if rule in rules), key=lambda i: (i is not None, i))
        want |= {(rule, n + 1, i) for n, i in enumerate(own)}
    assert {(r.rule, r.number, r.id) for r in made.collect()} == want
    assert {(r.rule, r.number) for r in sinks.rule_corpus(scripts, "rules", 2).collect()} == {(k, n) for k in ("r", "s0", "s1", None) for n in (1, 2)}
    plan = made._jdf.queryExecution().analyzed().toString()
    numbered = [line for line in plan.splitlines() if "row_number()" in line and "windowspecdefinition(" in line]
    assert numbered and all("part#" in line.split("windowspecdefinition(")[1] for line in numbered)
    assert sinks.rule_corpus(scripts.where("id = 7777"), "rules").count() == 0


def test_ingest_skips_known_versions(spark, tmp_path):
    spark.createDataFrame([("v1", 1), ("v2", 2)], "version string, x int").write.parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    query = jobs.incremental_ingest(stream, f"{tmp_path}/ck", lambda: spark.createDataFrame([("v1",)], "version string"), jobs.by_epoch(f"{tmp_path}/out"))
    assert query.awaitTermination(120) and [r.version for r in spark.read.parquet(f"{tmp_path}/out/0").collect()] == ["v2"]


def test_change_feed(spark, tmp_path):
    """The last row of a key counts, deletions make changes, and each batch begins where the one before ended."""
    old = spark.createDataFrame([(1, "a"), (2, "b"), (4, "x")], "key long, family string")
    batches = [[(1, "a", 1, False), (2, "z", 1, False), (2, "c", 2, False), (3, "d", 1, False), (9, None, 1, True)], [(3, "d", 3, False), (4, None, 3, True), (2, "b", 3, False)], [(4, "new", 4, False), (1, "q", 4, False), (1, None, 5, True)]]
    for rows in batches:
        spark.createDataFrame(rows, "key long, family string, at int, gone boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
    assert jobs.change_feed(stream, str(tmp_path), old, ["family"], "key", "at", "gone").awaitTermination(120)
    feed = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/changes")
    assert {(r.epoch, r.key, r.change) for r in feed.collect()} == {(0, 2, "updated"), (0, 3, "added"), (1, 4, "removed"), (1, 2, "updated"), (2, 4, "added"), (2, 1, "removed")}
    now = Snapshot.open(spark, f"{tmp_path}/snapshot").read()
    assert {(r.key, r.family) for r in now.collect()} == {(2, "b"), (3, "d"), (4, "new")}
