"""What findings of the third round asked for."""

import random

import pytest  # noqa: F401
from pyspark.sql import functions as F

from detectlake.operators import merkle, similarity
from detectlake.plans import analysis, browse, composite, feeds, registry  # noqa: F401


def test_names_of_all_lengths_are_defined(spark, tmp_path):
    """A name of any length that enough scripts hold has a definition."""
    names = ["a", "bc", "def", "ghij", "klmno"]
    pages = [(i, "".join(f'<a href="/{n}">' for n in names)) for i in range(4)] + [(9, '<a href="/once">')]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r.id, r.name, r.defined_in) for r in run("j11_calls_to_definitions")} == {(i, n, 0) for i in range(4) for n in names}
    assert {(r.id, r.name, r.rule) for r in run("r7_enriched_scripts")} == {(i, n, 0) for i in range(4) for n in names} | {(9, "once", None)}
    assert {r.value for r in run("m9_resolve_rules")} == {f"{n}{x}" for n in names if len(n) % 3 < 2 for x in ("/a", "/0")}


def test_places_with_several_items_are_in_one_order(spark, tmp_path):
    """of items in one place the smaller comes first, however the rows lie."""
    lines = [(1, 1, 0, 0, q, "A", "F", 0) for q in (9, 3, 7, 5)] + [(1, 2, 0, 0, 1, "A", "F", 0)]
    schema = "l_partkey long, l_linenumber int, l_orderkey long, l_suppkey long, l_quantity int, l_returnflag string, l_linestatus string, n int"
    spark.createDataFrame([(1, "n", "b", "T", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, schema).repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert registry.QUERIES["c11_rule_text"](spark, str(tmp_path)).first().rule_text.split("strings: ")[1] == '$s0 = "3" $s1 = "5" $s2 = "7" condition: any of them }'
    assert "ORDER BY ord, size)" in registry.ORACLES["c11_rule_text"]


def test_late_rows_of_tables_in_many_files(spark, tmp_path):
    """each part is one batch, though not all of the table's files hold rows of it."""
    path = f"{tmp_path}/events.parquet"
    for i in range(6):  # two files hold rows of all parts, four of the first only
        days = range(1, 29)
        ids = [(7 * (100 * i + d) + p, d) for d in days for p in ((0, 1, 5, 6) if i < 2 else (0, 1))]
        df = spark.createDataFrame(ids, "event_id long, day int")
        df.select("event_id", F.expr("make_timestamp(2024, 1, day, 3, 0, 0)").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.day: r.n for r in registry.QUERIES["r4_late_rows"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    # rows of the last part from days that ended before the watermark, the 27th at 3 o'clock, are dropped
    assert got == {f"2024-01-{d:02}": 12 + 2 + (2 if d >= 27 else 0) for d in range(1, 29)}


def shuffled(spark, run):
    """MB that an action writes to shuffles."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    before = written()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    return (written() - before) / 1e6


def test_versions_meet_in_one_lean_shuffle(spark):
    """an item with a place of its own goes through one shuffle, as its digest."""
    n = 40_000
    old = spark.range(0, n, 1, 8).select((F.col("id") % 4001).alias("owner"), (F.col("id") * 25).alias("ord"), F.lit(1).alias("sig_type"), F.lit(2).alias("size"), F.lit("c").alias("category"), F.lit("s").alias("subcategory"), F.sha2(F.col("id").cast("string"), 256).alias("data_hash"))
    new = old.where("ord % 97 <> 5")
    columns = ["sig_type", "size", "category", "subcategory", "data_hash"]
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    assert shuffled(spark, lambda: sink(merkle.entity_fingerprints(old))) < n * 100 / 1e6
    assert shuffled(spark, lambda: sink(merkle.changed_places(old, new, "owner", "ord", columns))) < 2 * n * 60 / 1e6
    assert shuffled(spark, lambda: merkle.sync_items(old, new, True)["entities"].count()) < 2 * n * 100 / 1e6


def test_copies_of_rules_give_a_row_each(spark):
    """rules of equal values are a class; what classes share is as before."""
    sets = {0: "abcdef", 1: "abcdeg", 2: "abcdez", 3: "xyz"}
    for copies in (1, 2, 20):
        rows = [("f", v, 100 * g + k) for g, s in sets.items() for v in s for k in range(copies)] * 2
        got = sorted(tuple(r) for r in similarity.shared_between_classes(spark.createDataFrame(rows, "field string, value string, guid long"), 5).collect())
        assert got == sorted([(0, 100, 5), (0, 200, 5), (100, 200, 5)] + [(100 * g, 100 * g + k, 6) for g in range(3) for k in range(1, copies)])


def test_sets_of_copies_are_shuffled_once(spark):
    """beside its rows, a key of a class gives a short row, however long its set is."""
    keys, values = 400, 300
    rows = spark.range(0, keys * values, 1, 4).select((F.col("id") % keys).alias("k"), F.floor(F.col("id") / keys).cast("string").alias("v"))
    got = []
    moved = shuffled(spark, lambda: got.extend(similarity.set_similarity(rows, "k", "v", 0.6).collect()))
    assert len(got) == keys - 1 and moved < keys * values * 10 / 1e6


def test_lists_of_items_are_made_in_pieces(monkeypatch):
    """items' lists become Arrow's piece by piece; nulls stay, also at the ends of pieces."""
    import pyarrow as pa

    from detectlake.functions import records

    items = [b"ab", None, b"", b"abcd", None, b"x", b"yz"]
    want = [None if v is None else [{"c": chr(c), "at": i} for i, c in enumerate(v)] for v in items]
    for size in (1, 3, 1 << 20):
        monkeypatch.setattr(records, "PIECE", size)
        got = records.listed(pa.array(items, pa.binary()), ("c", "at"), (pa.string(), pa.int32()), lambda v: [(chr(c), i) for i, c in enumerate(v)])
        assert got.to_pylist() == want
    assert records.listed(pa.array([], pa.binary()), ("c",), (pa.string(),), lambda v: []).to_pylist() == []


def test_functions_of_a_batch_go_on_in_pieces(spark):
    """a batch's functions aren't one piece."""
    body = "local t = {" + ", ".join(f"'{i:08}'" for i in range(2000)) + "}"
    rows = spark.range(0, 2000, 1, 1).select("id", F.concat(F.lit("function f"), F.col("id").cast("string"), F.lit("()\n" + body + "\nend")).alias("source"))
    from detectlake.functions import scripts

    found = scripts.function_bodies(rows, "id", "source")
    assert found.count() == 2000 and found.select(F.min(F.size("entries"))).first()[0] == 2000
    assert scripts.function_bodies(rows.where("id < 0"), "id", "source").count() == 0


def test_periods_are_found_without_a_python_call_for_each_entity(spark, tmp_path):
    """session windows give the periods that a merge by hand gives, also a gap apart to the microsecond and over batches."""
    from detectlake.streaming import jobs, periods

    day = 86_400_000_000
    times = {k: sorted({(k * 7 + i * (i + k) * 3_600_000_000 * 5) % (40 * day) for i in range(25)}) for k in range(20)}
    times[50], times[51] = [day, 3 * day, 5 * day + 1], [0]  # a gap apart, and a microsecond more
    times[60], times[61] = [45 * day], [42 * day]  # the newest, and one that the watermark is no more than a gap behind
    for half in (0, 1):
        rows = [("a", k, t) for k, ts in times.items() for t in ts if (t >= 20 * day) == bool(half)]
        spark.createDataFrame(rows, "entity_type string, entity_id long, t long").select("entity_type", "entity_id", F.timestamp_micros("t").alias("changed_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
    made = periods.ended_periods(stream, 2 * 86_400)
    assert "Python" not in made._jdf.queryExecution().analyzed().toString()
    with periods.use_timers(spark):
        found, _ = jobs.run_to_files(made, "append")
    got = {(r.entity_id, r.a, r.b, r.n) for r in found.select("entity_id", F.unix_micros("first_at").alias("a"), F.unix_micros("last_at").alias("b"), "n").collect()}
    assert got == {(k, *p) for k, ts in times.items() for p in periods.merged([(t, t, 1) for t in ts], 2 * day) if p[1] + 2 * day < 44 * day}
    assert (50, day, 3 * day, 2) in got and (61, 42 * day, 42 * day, 1) not in got


def test_grams_of_no_asked_item_stay_in_their_task(spark):
    """The bitmap keeps foreign grams in the task, no shared one is lost, and overlaps are what a count by hand gives."""
    rng = random.Random(3)
    word = lambda: bytes(rng.choices(b"abcdefghij \xff\x00", k=12))
    asked = [(-i, b"".join(word() for _ in range(20))) for i in range(1, 4)] + [(-9, b"short"), (-8, None)]
    items = [(i, b"".join(word() for _ in range(25)) + (asked[i % 3][1][17 : 17 + i] if i % 2 else b"")) for i in range(60)] + [(70, asked[0][1] * 2), (71, b""), (72, None)]
    made = lambda rows: spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "id long, data binary")
    left, right = made(asked), made(asked + items + items[:5])
    wanted = similarity.gram_bitmap(similarity.byte_grams(left, "id", "data", True).select("g"))
    every, some = similarity.byte_grams(right, "id", "data", False), similarity.byte_grams(right, "id", "data", False, wanted)
    assert 0 < wanted.sum() <= 3 * 240 and some.count() * 5 < every.count()
    got = {(r.a, r.b): (r.covered, r.share) for r in similarity.byte_overlap(left, right, "id", "data").collect()}
    expected = {}
    for a, x in asked:
        for b, y in asked + items:
            if x and y and len(x) // 2 <= len(y) <= len(x) * 2:
                held = {i + j for i in range(len(x) - 7) if x[i : i + 8] in y for j in range(8)}
                if held:
                    expected[a, b] = (len(held), min(1.0, len(held) / min(len(x), len(y))))
    assert got == expected and (-1, 70) in got


def test_posting_lists_are_made_before_they_are_shuffled(spark, monkeypatch):
    """a run of texts gives one list a term, of the trigrams of code points that queries ask for."""
    from detectlake.operators import textindex

    texts = [(1, 0, "Abcabc ÄÖ"), (2, 0, "xabcx\x00\x00y"), (3, 1, "abc😀😀🎉İ"), (4, 0, "ab"), (5, 0, ""), (6, 1, "line\nabc\r\n")]
    df = spark.createDataFrame(texts, "key long, block long, text string").coalesce(1)
    expected = {(t.lower()[i : i + 3], b, k) for k, b, t in texts for i in range(len(t.lower()) - 2)}
    lists = textindex.trigram_lists(df).collect()
    assert {(r.term, r.block, k) for r in lists for k in r["keys"]} == expected and len(lists) == len({(t, b) for t, b, _ in expected})
    monkeypatch.setattr(textindex, "GATHERED", 5)
    assert sorted((r.term, r.block, k) for r in textindex.trigram_lists(df).collect() for k in r["keys"]) == sorted(expected)


def test_batches_of_changes_are_dealt_by_key_before_they_are_sorted(spark, tmp_path, monkeypatch):
    """the rows of a batch's file aren't sorted in the task that reads it."""
    from detectlake.streaming import jobs

    plans, write = [], jobs.materialise
    monkeypatch.setattr(jobs, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df, name))
    rows = spark.range(40).selectExpr("id % 20 key", "concat('s', id) status", "id at", "false gone")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    first = rows.select("key", "status").limit(0)
    jobs.change_feed(jobs.file_stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", first, ["status"], "key", "at", "gone").awaitTermination()
    assert plans and all("REPARTITION_BY_COL" in p for p in plans)
    got = jobs.Snapshot.open(spark, f"{tmp_path}/out/snapshot").read().collect()
    assert {(r.key, r.status) for r in got} == {(k, f"s{k + 20}") for k in range(20)}
