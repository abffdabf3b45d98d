"""What findings of the fourth round asked for."""

import math
import random

import duckdb
import numpy as np
import pytest

from detectlake.operators import setblocks, similarity
from detectlake.plans import analysis, browse, composite, feeds, registry  # noqa: F401
from detectlake.sources import readers

from .test_findings_r03 import shuffled


def oracle(folder, name, **tables):
    """DuckDB's rows of a query over tables in a folder, sorted as text."""
    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"create view {table} as select * from '{folder}/{path}/*.parquet'")
    return sorted(map(repr, con.execute(registry.ORACLES[name]).fetchall()))


def result(spark, folder, name, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in registry.QUERIES[name](spark, str(folder)).collect())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents without text, id or names, with line ends and spaces in names, and with entropies halfway between two roundings."""
    folder = tmp_path_factory.mktemp("odd")
    rows = [(0, "", "en", "a"), (1, None, "en", "a"), (2, "abc", None, "a"), (3, "abc", "en", None), (4, "abc", "", ""), (5, "abc", "en", "a\nb"), (6, "abc", " en ", "\t"), (8, "abc", "en", "a\r\nb"), (9, "a\rb", "en", "a\rb"), (None, "abc", "en", "a")]
    rows += [(10, "é1234567", "en", "a"), (11, "é12345678", "en", "a"), (12, "x" * 5000, "en", "a"), (13, "x" * 5001, "en", "a"), (14, "abc", 'q"', 'x\\,"')]
    rows += [(20 + n, "a" * (64 - n) + "".join(chr(65 + i) for i in range(n)), "en", "a") for n in (32, 48, 56)]
    # entropy 2.40625 and 4.65625
    rows += [(100, "a" * 32 + "b" * 8 + "c" * 16 + "d" * 2 + "efghij", "en", "a"), (101, "".join(chr(40 + i) * (1 + i % 2 + 2 * (i % 4 == 3)) for i in range(32)), "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name, columns", [("c14_entropy", ["id", "entropy"]), ("c3_printable_share", ["id", "printable"]), ("s5_record_csv", ["threat_id", "threat_name", "size", "hex_data", "is_lua"])])
def test_documents_without_bytes(spark, odd, name, columns):
    """empty and missing texts, and cells of any form, are as SQL has them."""
    assert result(spark, odd, name, columns) == oracle(odd, name, documents="documents.parquet")


def test_lines_of_other_writers(spark, tmp_path):
    """lines may end as Python's writer ends them."""
    (tmp_path / "x.csv").write_bytes(b'threat_id,threat_name,sig_type,sig_type_name,size,offset,is_lua,hex_data\r\n1,"a\nb",1,,3,0,TRUE,616263\r\n2,"",1,x,0,0,,\r\n')
    got = readers.read_record_csv(spark, str(tmp_path)).orderBy("threat_id").collect()
    assert [tuple(r) for r in got] == [(1, "a\nb", 1, None, 3, 0, True, "616263"), (2, "", 1, "x", 0, 0, False, None)]


def rule_tables(spark, folder, sets):
    """Rules (guid, its values) as lines, parts and suppliers; values are numbers."""
    values = sorted({v for s in sets.values() for v in s})
    spark.createDataFrame([(v, f"Name{v}", f"T{v % 3}", "Brand#1", 1) for v in values], "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    lines = [(g, v) for g, s in sets.items() for v in s] * 2
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").repartition(4).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(g, f"Supplier#{g}") for g in sets], "s_suppkey long, s_name string").write.parquet(f"{folder}/supplier.parquet")
    return {t: f"{t}.parquet" for t in ("part", "lineitem", "supplier")}


def test_all_rules_that_share_a_value(spark, tmp_path):
    """one shared value is enough, and rules of equal values are pairs as others are."""
    sets = {1: range(6), 2: range(6), 3: range(6), 4: [5, 6], 5: [7], 6: [6, 7]}
    tables = rule_tables(spark, tmp_path, sets)
    got = {(r.a, r.b, r.n) for r in registry.QUERIES["j13_shared_between_rules"](spark, str(tmp_path)).collect()}
    assert got == {(a, b, len(set(sets[a]) & set(sets[b]))) for a in sets for b in sets if a < b and set(sets[a]) & set(sets[b])} and (1, 4, 1) in got and (2, 3, 6) in got
    assert result(spark, tmp_path, "j13_shared_between_rules", ["a", "b", "n"]) == oracle(tmp_path, "j13_shared_between_rules", **tables)


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """400 rules that differ, each with most of the same values, so that all pairs share very many."""
    folder, draw = tmp_path_factory.mktemp("crowd"), random.Random(5)
    return folder, rule_tables(spark, folder, {g: draw.sample(range(120), 95) for g in range(400)})


def test_crowded_rules_are_not_broadcast(spark, crowd):
    """what rules share is worked out without a list of all postings in the driver."""
    folder, tables = crowd
    found = registry.QUERIES["j13_shared_between_rules"](spark, str(folder))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = []
    assert shuffled(spark, lambda: rows.extend(found.collect())) < 2 and len(rows) == 400 * 399 / 2
    assert result(spark, folder, "j13_shared_between_rules", ["a", "b", "n"]) == oracle(folder, "j13_shared_between_rules", **tables)


@pytest.mark.parametrize("name, columns", [("m5_store_pairs", ["a", "b", "score", "kind"]), ("f12_min_score", ["a", "b", "score"])])
def test_similar_rules_are_not_shuffled(spark, crowd, name, columns):
    """sets go to blocks once, and neither postings nor pairs go through a shuffle."""
    folder, tables = crowd
    rows = []
    assert shuffled(spark, lambda: rows.extend(registry.QUERIES[name](spark, str(folder)).collect())) < 1.1 and len(rows) > 10_000
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == oracle(folder, name, **tables)


def test_products_and_postings_give_the_same_pairs(spark, monkeypatch):
    """pairs by blocks and by postings are those of brute force, for common values, rare ones and both."""
    draw = random.Random(7)
    common, rare = range(30), range(100, 2000)
    kinds = [lambda: draw.sample(common, 22), lambda: draw.sample(rare, 9), lambda: draw.sample(common, 20) + draw.sample(rare, 5)]
    sets = {g: set(kinds[g % 3]()) for g in range(150)} | {500: {1}, 501: {1}, 502: {100, 3000}, 503: {3001}}
    df = spark.createDataFrame([(f"f{v % 2}", f"v{v}", g) for g, s in sets.items() for v in s], "field string, value string, guid long")
    shares = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    first = {g: min(h for h in sets if sets[h] == sets[g]) for g in sets}
    near = {(a, b): n / len(sets[a] | sets[b]) for (a, b), n in shares.items() if first[a] == a and first[b] in (a, b)}
    for dear in (0, 1e12):
        monkeypatch.setattr(similarity, "MEETING", dear)
        for least in (1, 3):
            got = similarity.shared_between(df, least, 8).collect()
            assert sorted(map(tuple, got)) == sorted((a, b, n) for (a, b), n in shares.items() if n >= least)
        got = {(r.a, r.b): r.score for r in similarity.set_similarity(df, "guid", "value", 0.5).collect()}
        assert got == {p: math.floor(s * 1e4 + 0.5) / 1e4 for p, s in near.items() if s >= 0.5} and len(got) > 500
    listed = similarity.whole_sets(similarity.rule_hashes(df))
    got = setblocks.block_pairs(listed, setblocks.counts_from(1), "n long", 20).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, n) for (a, b), n in shares.items())


def test_columns_in_pieces(monkeypatch):
    """counts are the same however many values and cells a task holds at once."""
    draw, want = np.random.default_rng(3), None
    sets = [draw.choice(60, 40, replace=False) if i % 2 else draw.choice(5000, 30, replace=False) for i in range(90)]
    flat = [np.concatenate(s) for s in (sets[:50], sets[50:])]
    sizes = [np.array([len(s) for s in x]) for x in (sets[:50], sets[50:])]
    blocks = [setblocks.Block(setblocks.packed(np.arange(len(n)), n, f)) for n, f in zip(sizes, flat, strict=True)]
    want = [[len(np.intersect1d(a, b)) for b in sets[50:]] for a in sets[:50]]
    for cells in (1, 500, 1 << 22):
        monkeypatch.setattr(setblocks, "CELLS", cells)
        assert np.array_equal(setblocks.shared(*blocks), want)
