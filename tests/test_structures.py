"""Segmented scans, automata, logs of snapshots and hash trees against plain walks of the same rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from detectlake.operators import dictionary, merkle, similarity, windows
from detectlake.sources import readers, segments
from detectlake.streaming import snapshots


def record(kind, data):
    return bytes([kind, len(data) & 255]) + (len(data) >> 8).to_bytes(2, "little") + data


def payload(r, n, kind):
    return [r.randbytes(n), (b"lorem ipsum dolor\n" * (n // 18 + 1))[:n], bytes(n), b"\n" * n][kind]


@pytest.fixture(scope="module")
def containers(tmp_path_factory):
    r, files = random.Random(5), {}
    for i in range(8):
        files[f"f{i}.bin"] = b"".join(record(r.randrange(256), payload(r, r.choice([0, 1, 5, 40, 300, 900]), r.randrange(4))) for _ in range(20))
    files["f1.bin"] += b"\x01\xff\xff\xff tail"  # overruns the file
    files["f2.bin"] += b"\x01\x02"  # half a head
    files["f3.bin"] = b"\xef\xbb\xbf\x00" + files["f3.bin"] * 20  # begins with what readers take for a mark
    files["f4.bin"] = b""
    files["f5.bin"] = b"\xff" * 3000  # one record that never ends
    files["f6.bin"] = record(7, payload(r, 6000, 1)) + files["f6.bin"]  # over many ranges
    folder = tmp_path_factory.mktemp("containers")
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder), files


@pytest.mark.parametrize(("split", "most"), [(6_000, 700), (1 << 27, 300), (1 << 27, 1 << 22)])
def test_segmented_scan(spark, containers, split, most):
    """Records across ranges, splits and long runs are as the serial walk gives them."""
    folder, files = containers
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 4096)
        got = Counter((x.path.rsplit("/", 1)[1], x.sig_type, x.size, bytes(x.data), x.offset) for x in segments.scan_records(spark, folder, most).collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == Counter((n, *x) for n, b in files.items() for x in readers.records_of(b))
    assert any(n == "f6.bin" and size == 6000 for n, _, size, _, _ in got) and got.total() > 100


def test_guesses_meet_the_chain():
    """A vote from anywhere finds the exit of a chain of records; walks from a known entry need none."""
    r = random.Random(1)
    data = b"".join(record(r.randrange(256), payload(r, r.randrange(20, 200), r.randrange(2))) for _ in range(500))
    starts = [x[3] for x in readers.records_of(data)]
    end = starts[400] + 3
    assert segments.walk(data[: end + 4], end, 0) == (starts[401], starts[400])
    cut = starts[3] + 9
    assert segments.guessed_exit(data[cut : end + 4], end - cut) == starts[401] - cut


def test_blocks_over_spans(spark):
    """Blocks come out the same however few bytes are ordered together."""
    r = random.Random(3)
    rows = [(f"p{p}", o * 7, r.choice("be....."), o) for p in range(4) for o in range(120)] + [("none", 0, ".", 1)]
    df = spark.createDataFrame(rows, "path string, offset long, kind string, n int")
    want = {}
    for p in {x[0] for x in rows}:
        own, at = sorted((x for x in rows if x[0] == p), key=lambda x: x[1]), None
        for i, (_, offset, kind, _) in enumerate(own):
            ahead = next((x[2] for x in own[i + 1 :] if x[2] in "be"), None)
            at = (offset if ahead == "e" else None) if kind == "b" else None if kind == "e" else at
            want[p, offset] = None if kind in "be" else at
    for span in (10, 100, 1 << 22):
        found = windows.assign_blocks(df, F.col("kind") == "b", F.col("kind") == "e", {"from_n": F.col("n")}, span)
        assert found.columns == [*df.columns, "block", "from_n"]
        got = found.collect()
        assert {(x.path, x.offset): x.block for x in got} == want and len(got) == len(rows)
        assert all(x.from_n is None if x.block is None else x.from_n * 7 == x.block for x in got)


@pytest.mark.parametrize("terms", [10, 1_001, 50_000])
def test_hits_of_dictionaries_of_all_sizes(spark, terms):
    r = random.Random(terms)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 7)))
    known = list(dict.fromkeys(["aa", "aaa", "a", *(word() for _ in range(terms))]))
    texts = [(i % 9 if i % 10 else None, " ".join(word() for _ in range(12))) for i in range(40)] + [(50, None), (51, ""), (52, "aaaa"), (52, "aaaa")]
    dictionary_of = spark.createDataFrame([(t,) for t in known] + [(None,), ("",), ("aa",)], "term string")
    df = spark.createDataFrame(texts, "id long, s string")
    every = Counter((k, known_term, at) for k, t in texts if t for known_term in set(known) & {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)} for at in range(len(t)) if t.startswith(known_term, at))
    for sizes in ({}, {"sent": 0, "shard": max(40, terms), "group": 400}):
        got = dictionary.term_hits(df, "id", "s", dictionary_of, every=True, **sizes).collect()
        assert Counter((x.id, x.term, x.offset) for x in got) == every
        once = dictionary.term_hits(df, "id", "s", dictionary_of, **sizes)
        assert once.agg(F.sum("n")).first()[0] == every.total()
        assert {(x.offset, x.n) for x in once.where("id = 52 AND term = 'aa'").collect()} == {(0, 3)}
    assert dictionary.term_hits(df, "id", "s", dictionary_of.where("term is null")).count() == 0
    assert dictionary.term_hits(df.where("id = 99"), "id", "s", dictionary_of, sent=0).count() == 0


def bytes_of(path, tmp_path):
    return sum(f.stat().st_size for f in (tmp_path / path).rglob("*.parquet"))


def test_snapshot_log(spark, tmp_path):
    """The state after each epoch is as a plain dictionary has it; repeated epochs do no harm; little is written for few changes."""
    base = {i: (f"v{i}", i % 3 if i % 5 else None) for i in range(20_000)}
    df = lambda rows: spark.createDataFrame(rows, "key long, name string, n int, deleted boolean")
    first = spark.createDataFrame([(k, *v) for k, v in base.items()], "key long, name string, n int")
    state = snapshots.Snapshot(spark, str(tmp_path), first.schema, "key", most_deltas=3)
    state.start(first)
    whole = bytes_of("base/-1", tmp_path)
    r = random.Random(2)
    for epoch in range(6):
        changes = {k: (k, f"e{epoch}", None, r.random() < 0.3) for k in r.sample(range(20_050), 12)}
        before = dict(base)
        for times in range(2 if epoch in (2, 4) else 1):  # an epoch that fails after its commit comes again
            state.apply(df(list(changes.values())), epoch)
            assert {x.key: (x.name, x.n) for x in state.read(epoch).collect()} == before or times
        for k, name, n, deleted in changes.values():
            base.pop(k, None)
            if not deleted:
                base[k] = (name, n)
        if epoch != 3:
            assert bytes_of(f"delta/{epoch}", tmp_path) < whole / 4
        keys = spark.createDataFrame([(k,) for k in list(changes)[:3]], "key long")
        assert {x.key: (x.name, x.n) for x in state.read(keys=keys).collect()} == {k: base[k] for k in list(changes)[:3] if k in base}
    assert {x.key: (x.name, x.n) for x in snapshots.Snapshot.open(spark, str(tmp_path)).read().collect()} == base
    made = state.manifest()
    assert made.base == "base/3" and made.deltas == ("delta/4", "delta/5") and not (tmp_path / "base/-1").exists()
    assert snapshots.Snapshot.open(spark, f"{tmp_path}/nothing") is None
    # what an epoch leaves behind without a manifest isn't seen
    df([(1, "lost", 0, False)]).write.parquet(f"{tmp_path}/delta/9")
    assert {x.key: (x.name, x.n) for x in state.read().collect()} == base


ITEM = "owner long, ord long, sig_type int, size int, category string, subcategory string, data_hash string"


def test_fingerprints_tell_everything_apart(spark):
    """Nulls, lengths, cuts between values, payloads, places and repeats all tell; the order of rows doesn't."""
    variants = [
        [(1, 1, 1, 5, None, "x", "h")], [(1, 1, 1, 5, "x", None, "h")], [(1, 1, 1, 5, "a|b", "c", "h")], [(1, 1, 1, 5, "a", "b|c", "h")], [(1, 1, 1, 5, "", "x", "h")],
        [(1, 1, 1, 5, None, "x", "other")], [(1, 2, 1, 5, None, "x", "h")], [(1, 1, 1, 5, None, "x", "h")] * 2, [(1, 1, 1, 5, None, "x", None)],
        [(1, 1, 1, 5, None, "x", "h"), (1, 5000, 1, 5, None, "x", "h")], [(1, 1, 1, 5, None, "x", "h"), (1, 5_000_000, 1, 5, None, "x", "h")],
    ]
    rows = [(i, *x[1:]) for i, items in enumerate(variants) for x in items]
    found = merkle.entity_fingerprints(spark.createDataFrame(rows, ITEM)).collect()
    assert len({x.fingerprint for x in found}) == len(variants) and sum(x.n_items for x in found) == len(rows)
    again = merkle.entity_fingerprints(spark.createDataFrame(rows[::-1], ITEM).repartition(3)).collect()
    assert {x.owner: x.fingerprint for x in again} == {x.owner: x.fingerprint for x in found}
    assert merkle.entity_fingerprints(spark.createDataFrame([], ITEM)).count() == 0


def test_versions_differ_where_their_trees_do(spark):
    old = [(o, p * 300, 1, 5, None, "x", f"h{o}{p}") for o in range(6) for p in range(40)] + [(7, None, 1, 1, None, None, None)]
    new = [x for x in old if x[0] != 2 and (x[0], x[1]) != (3, 600)]
    new = [(*x[:6], "new") if (x[0], x[1]) in ((1, 0), (4, 11_700)) else x for x in new] + [(9, 1, 1, 1, None, "n", "h"), (0, 12_345, 1, 1, None, "n", "h"), (5, 0, 1, 5, None, "x", "h50")]
    x, y = (spark.createDataFrame(v, ITEM) for v in (old, new))
    columns = ["sig_type", "size", "category", "subcategory", "data_hash"]
    got = {(r.owner, r.ord, r.change) for r in merkle.changed_places(x, y, "owner", "ord", columns).collect()}
    want = {(2, p * 300, "removed") for p in range(40)} | {(3, 600, "removed"), (1, 0, "updated"), (4, 11_700, "updated"), (9, 1, "added"), (0, 12_345, "added"), (5, 0, "updated")}
    assert got == want and merkle.changed_places(x, x, "owner", "ord", columns).count() == 0
    for full in (True, False):
        done = merkle.sync_items(x, y, full)
        assert {(r.owner, r.change) for r in done["entities"].collect()} == {(1, "updated"), (3, "updated"), (4, "updated"), (0, "updated"), (5, "updated"), (9, "added")} | ({(2, "removed")} if full else set())
        after = Counter(tuple(r) for r in done["items"].where("owner is not null").collect())
        assert after == Counter(new + ([] if full else [v for v in old if v[0] == 2]))
    assert merkle.sync_mode(None, {"a": "1"}, ["a"]) == "full" and merkle.sync_mode({"a": "1"}, {"a": "1"}, ["a"]) == "known"
    assert merkle.sync_mode({"a": "1", "b": "1"}, {"a": "1", "b": "2"}, ["a"]) == "incremental" and merkle.sync_mode({"a": "1"}, {"a": "2"}, ["a"]) == "full"


def test_equal_sets_give_as_many_pairs_as_keys(spark):
    """Equal sets are a class whose first key alone meets others; pairs grow as keys do."""
    for n in (50, 200):
        rows = [(k, v) for k in range(n) for v in "abcdefgh"] + [(1000 + k, v) for k in range(3) for v in "abcdefg"] + [(2000, "z")]
        got = {(r.a, r.b, r.score) for r in similarity.set_similarity(spark.createDataFrame(rows, "k long, v string"), "k", "v", 0.6).collect()}
        assert got == {(0, k, 1.0) for k in range(1, n)} | {(1000, 1001, 1.0), (1000, 1002, 1.0), (0, 1000, 0.875)}


def test_rules_that_share_enough_meet(spark):
    r = random.Random(4)
    sets = {g: {("f", str(r.randrange(60))) for _ in range(r.randrange(1, 25))} for g in range(40)}
    df = spark.createDataFrame([(*v, g) for g, s in sets.items() for v in s] * 2, "field string, value string, guid long")
    for least, block in ((1, 512), (4, 7), (9, 3)):
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
        assert {tuple(x) for x in similarity.shared_between(df, least, block).collect()} == want


def test_text_index_finds_what_a_scan_finds(spark, tmp_path):
    """Short, rare, common and missing strings, wildcard signs, letters beyond ASCII, in two segments; few files are read."""
    from detectlake.operators.filters import icontains
    from detectlake.operators.textindex import TextIndex, tokens

    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["Alpha", "beta", "gamma_1", "50%", "Über", "naïve", "x"]) for _ in range(r.randrange(0, 9)))) for i in range(-50, 400)]
    rows += [(900, None), (901, ""), (902, "the needle's\nown\\place"), (903, "Needle"), (70_000, "far away needle"), (9_000_000, "x" * 5_000 + "END")]
    df = spark.createDataFrame(rows, "id long, s string")
    index = TextIndex(spark, str(tmp_path / "grams"), span=100)
    words = TextIndex(spark, str(tmp_path / "words"), "tokens", span=100)
    for made in (index, words):
        made.add(df.where("id % 2 = 0"), "id", "s")
        made.add(df.where("id % 2 <> 0"), "id", "s")
    for q in ("needle", "NEEDLE'S\nOWN", "\\place", "a_1", "50% üb", "%", "_", "be", "x", "xxxend", "nothing here", "alpha beta", "ÜBER"):
        want = {x.id for x in df.where(icontains("s", q) & F.col("s").isNotNull()).collect()}
        assert {x.key for x in index.containing(q).collect()} == want, q
        assert {x.key for x in words.containing(q).collect()} == want, q
    for q in ("needle", "alpha über", "gamma 1", "place OWN", "missing alpha", "x end", "?!"):
        asked = {w.lower() for w in re.findall(r"[^\W_]+", q)}
        want = {i for i, s in rows if asked and asked <= {w.lower() for w in re.findall(r"[^\W_]+", s or "")}}
        assert {x.key for x in words.with_tokens(q).collect()} == want == {x.key for x in index.with_tokens(q).collect()}, q
    assert spark.range(1).select(tokens(F.lit("a_B 1-2"))).first()[0] == ["a", "b", "1", "2"]
    # the lists of a search lie in the buckets of its own terms, and only its candidates' texts are read
    own, every = index.lists(["nee", "eed"]).inputFiles(), list((tmp_path / "grams").rglob("lists/**/*.parquet"))
    assert 0 < len(own) <= 4 and len(every) > 40
    assert len(index.texts({700}).inputFiles()) == 1 and len(index.texts().inputFiles()) > 8
    assert TextIndex(spark, str(tmp_path / "none")).containing("needle").count() == 0


def test_deep_pages_read_their_own_ranges(spark, tmp_path):
    from detectlake.operators.ordered import PageIndex

    r = random.Random(8)
    rows = [(i, r.choice([None, 1, 2, 2, 2, 3, r.randrange(1000)])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, v int")
    index = PageIndex.build(df, [F.desc("v"), F.asc("id")], str(tmp_path / "pages"), ranges=12)
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert index.total == 3_000
    for number, size in ((1, 25), (2, 7), (40, 50), (60, 50), (61, 50), (1, 5_000), (430, 7)):
        got = [(x.id, x.position) for x in sorted(index.page(number, size).collect(), key=lambda x: x.position)]
        assert got == [(order[i][0], i) for i in range((number - 1) * size, min(3_000, number * size))]
    assert len(index.ranges_of(1_500, 1_520)) <= 2 and index.ranges_of(3_000, 3_020) == []
    empty = PageIndex.build(df.where("id < 0"), [F.asc("id")], str(tmp_path / "empty"), ranges=4)
    assert empty.total == 0 and empty.page(1, 10).count() == 0


def test_sketches_of_days_merge(spark, tmp_path):
    """Estimates over ranges, from several loads with overlapping values, are within the stated error; days without rows are fine."""
    from detectlake.operators import sketches

    rows = spark.range(60_000).selectExpr("date_add(date'2024-01-01', cast(id % 40 as int)) AS day", "concat('k', id % 3) AS kind", "cast(hash(id) % 9000 as string) AS value").where("day <> date'2024-01-05'")
    rows = rows.unionByName(rows.limit(10).withColumn("value", F.lit(None).cast("string")))
    for i, part in enumerate(("value < '4'", "value >= '3' OR value IS NULL")):
        sketches.store(sketches.daily(rows.where(part), "day", "kind", "value"), f"{tmp_path}/{i}")
    table = spark.read.parquet(f"{tmp_path}/0", f"{tmp_path}/1")
    ranges = spark.sql("SELECT * FROM VALUES (date'2024-01-01', date'2024-01-02'), (date'2024-01-04', date'2024-01-20'), (date'2024-01-01', date'2025-01-01'), (date'2023-01-01', date'2023-02-01') AS t(since, until)")
    got = {(r.kind, r.since, r.until): r.estimate for r in sketches.between(table, ranges).collect()}
    exact = rows.join(ranges, F.expr("day >= since AND day < until")).groupBy("kind", "since", "until").agg(F.countDistinct("value").alias("n")).collect()
    assert len(got) == len(exact) == 9 and all(abs(got[x.kind, x.since, x.until] / x.n - 1) <= sketches.ERROR for x in exact)


def test_state_ends_with_event_time(spark, tmp_path):
    """Periods come once event time has passed them, joined over batches and late rows; open ones stay, and what is too late is dropped."""
    from detectlake.streaming import jobs, periods

    at = lambda day, hour=0: f"2024-01-{day:02} {hour:02}:00:00"
    batches = [
        [("a", 1, at(1)), ("a", 1, at(2)), ("b", 2, at(3)), (None, None, at(1, 5)), ("a", 1, None)],
        [("a", 1, at(4)), ("b", 2, at(10)), ("a", 9, at(9, 12))],  # the watermark is then day 9
        [("b", 2, at(11)), ("a", 9, at(9, 1))],
        [("a", 1, at(2, 3)), ("z", 0, at(20))],  # the first is too late by days: rows are held to the watermark that the batch before had
    ]
    for rows in batches:
        spark.createDataFrame(rows, "entity_type string, entity_id long, at string").select("entity_type", "entity_id", F.to_timestamp("at").alias("changed_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
    with periods.use_timers(spark):
        found, query = jobs.run_to_files(periods.ended_periods(stream, 2 * 86_400), "append")
    got = {(r.entity_type, r.entity_id, str(r.first_at), str(r.last_at), r.n) for r in found.collect()}
    assert got == {("a", 1, at(1), at(4), 3), ("b", 2, at(3), at(3), 1), ("b", 2, at(10), at(11), 2), (None, None, at(1, 5), at(1, 5), 1), ("a", 9, at(9, 1), at(9, 12), 2)}
    assert periods.merged([(5, 6, 1), (1, 2, 1), (4, 4, 2)], 1) == [(1, 2, 1), (4, 6, 3)]


def test_late_rows_over_very_many_batches(spark, tmp_path):
    """A listener counts late rows of more batches than a query remembers."""
    from detectlake.streaming import jobs

    n = 115
    for i in range(n):
        late = ", (timestamp'2023-01-01 00:00:00')" if i % 10 == 3 else ""
        spark.sql(f"SELECT col1 AS changed_at FROM VALUES (timestamp'2024-03-01 00:00:00' + INTERVAL {i} HOURS){late}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
    with jobs.LateRows(spark) as late:
        _, query = jobs.run_to_files(jobs.daily_counts(stream), "update", ["day"])
        assert late.of(query) == 12 and late.batches[str(query.id)] >= n and len(query.recentProgress) <= 100


def test_profiles_of_items(spark):
    """Bytes of all kinds, none at all, null data and repeated ids."""
    from detectlake.operators import profiles

    rows = [(1, "a", b"MZ\x90\x00" + bytes(12) + b"hello evil evil" + b"\xff\xfe"), (2, "a", b""), (3, None, None), (4, "b", b"\x1f\x8babcd"), (4, "b", b"evil")]
    df = spark.createDataFrame([(i, o, None if d is None else bytearray(d)) for i, o, d in rows], "id long, owner string, data binary")
    terms = spark.createDataFrame([("evil",), ("vil e",), ("",)], "term string")
    got = sorted(profiles.item_profiles(df, terms).collect(), key=lambda r: (r.id, r["size"]))
    assert [(r.id, r["size"], r.magic, r.magic_bytes, r.string_regions, r.string_bytes, r.null_bytes, r.hits, r.terms) for r in got] == [
        (1, 33, ["PE/DOS Executable"], 2, 1, 15, 13, 3, ["evil", "vil e"]),
        (2, 0, [], 0, 0, 0, 0, 0, []),
        (3, 0, [], 0, 0, 0, 0, 0, []),
        (4, 4, [], 0, 1, 4, 0, 1, ["evil"]),
        (4, 6, ["GZIP Compressed"], 2, 1, 4, 0, 1, ["evil"]),
    ]
    whole = {r.owner: r for r in profiles.entity_profiles(df, terms).collect()}
    assert whole["a"]["items"] == 2 and whole["a"]["hits"] == 3 and whole[None].magic == [] and whole["b"].magic == ["GZIP Compressed"]
    assert profiles.entity_profiles(df.where("id > 9"), terms).count() == 0


def test_bundles_hold_payloads_and_are_guarded(spark):
    from detectlake.sources import sinks

    entities = spark.createDataFrame([(1,), (2,)], "signature_id long")
    items = spark.createDataFrame([(1, 1, 1, 3, bytearray(b"\x00ab")), (1, 2, 1, 0, None)], "owner long, ord long, sig_type int, size int, data binary")
    got = sinks.bundle_export(entities, items, [2, 1]).collect()
    assert [r.items for r in got] == ["[]", '[{"ord":1,"sig_type":1,"size":3,"data":"006162"},{"ord":2,"sig_type":1,"size":0}]']
    # the bytes themselves count, whatever the size says
    large = items.limit(1).withColumn("data", F.encode(F.repeat(F.lit("x"), 9 << 20), "UTF-8"))
    with pytest.raises(ValueError, match="too many items"):
        sinks.bundle_export(entities, large, [1])


def test_activity_up_to_today(spark):
    from datetime import date

    from detectlake.operators.aggregates import daily_activity

    df = spark.sql("SELECT to_timestamp(x) AS changed_at FROM VALUES ('2024-01-03 10:00:00'), ('2024-01-03 11:00:00'), ('2024-01-05 00:00:00'), (NULL) AS t(x)")
    told = lambda **k: [(str(r.day), r.n) for r in sorted(daily_activity(df, **k).collect())]
    assert told() == [("2024-01-03", 2), ("2024-01-04", 0), ("2024-01-05", 1)]
    assert told(today=date(2024, 1, 7), days=4) == [("2024-01-04", 0), ("2024-01-05", 1), ("2024-01-06", 0), ("2024-01-07", 0)]
    assert told(today=date(2024, 1, 4), days=90, tracked_since=date(2024, 1, 2)) == [("2024-01-02", 0), ("2024-01-03", 2), ("2024-01-04", 0)]
    assert told(today=date(2024, 1, 1), tracked_since=date(2024, 1, 2)) == []
    assert daily_activity(df.where("changed_at is null"), today=date(2024, 1, 7)).count() == 0
