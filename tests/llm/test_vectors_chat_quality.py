"""Vector search, chat windows, the classifier and the pipeline against brute force, on awkward rows and on none."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from detectlake.llm import ann, chat, mixing, pipeline, quality, topk


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.standard_normal(12).astype(np.float32)]) for i in range(600)]
    rows += [(1000 + i, rows[40][1]) for i in range(30)]  # ties
    rows += [(700, None), (701, []), (702, [0.0] * 12), (703, [float("nan")] + [1.0] * 11), (704, [float("inf")] * 12), (705, [None] + [1.0] * 11), (None, rows[3][1]), (800, [1.0, 2.0]), (760, [3.0, -1.0]), (801, rows[5][1]), (801, rows[5][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"row": F.lit("x"), "v": F.lit(1), "dim": F.lit("y"), "score": F.lit(0.5)})


def usable(df, zero):
    out = []
    for r in df.select("vec_id", "embedding").collect():
        v = r.embedding
        if r.vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out.append((r.vec_id, np.array(v, np.float64)))
    return out


def brute(rows, every, k, score):
    out = Counter()
    for q, x in rows:
        if q % every == 0:
            near = sorted(((-score(x, y), c) for c, y in rows if c != q and len(y) == len(x) and len(x)))[:k]
            out.update((q, i + 1, c, -s) for i, (s, c) in enumerate(near))
    return out


@pytest.mark.parametrize("block", [16_384, 100])
def test_exact_topk(vectors, block):
    scaled = [(i, np.floor(256 * v).astype(int)) for i, v in usable(vectors, True)]
    want = brute(scaled, 50, 5, lambda a, b: int(a @ b))
    got = Counter(map(tuple, topk.exact_topk(vectors, block_rows=block, query_rows=7).collect()))
    assert got == want
    assert topk.exact_topk(vectors.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("block", [16_384, 40])
def test_exact_topk_keeps_large_components(spark, block):
    """Large finite components take part, and products beyond doubles' whole numbers are exact."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(6).astype(np.float32)]) for i in range(200)]
    rows += [(300 + i, [float(np.float32(s * 2.0**e)) for s in rng.standard_normal(6)]) for i, e in enumerate([19, 20, 20, 21, 21, 21] * 3)]  # products near 2^58
    rows += [(400, [2.0**21] * 6), (401, [2.0**21] * 5 + [2.0**21 + 1]), (402, [2.0**21 + 0.25] + [2.0**21] * 5)]
    rows += [(500, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (501, [-1.0] + [0.0] * 5)]
    rows += [(601, [0.0, -(2.0**60), 2.0**60, 0.0, 0.0, 0.0]), (650, [1.0, 1.0, 1.0, 2.0, 0.0, 0.0])]  # sums that cancel
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id < 600")
    scaled = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = brute([x for x in scaled if x[0] < 600], 50, 5, product)
    assert Counter(map(tuple, topk.exact_topk(df, block_rows=block, query_rows=7).collect())) == want
    assert any(c >= 300 for _, _, c, _ in want)
    some = spark.createDataFrame([r for r in rows if r[0] in (601, 650) or r[0] < 5], "vec_id long, embedding array<double>").where("vec_id <> 0")
    got = [tuple(r) for r in topk.exact_topk(some, k=2, block_rows=block).where("query_id = 650").orderBy("rank").collect()]
    near = sorted((-product(dict(scaled)[650], v), i) for i, v in scaled if i in (601, 1, 2, 3, 4))[:2]
    assert got == [(650, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    with pytest.raises(Exception, match="long|large|Overflow"):
        topk.exact_topk(spark.createDataFrame([(0, [2.0**60]), (1, [2.0**60])], "vec_id long, embedding array<double>")).collect()


def test_lists_are_read_in_order():
    """Reading ends early where scores are apart, nothing among the k best is lost, and bars cut deeper."""
    rng = np.random.default_rng(2)
    rows = np.floor(256 * rng.standard_normal((3_000, 16)) / 4)
    rows[:40] += 900 * np.sign(rows[0])
    lists, exact, far = topk.SortedLists(np.arange(3_000), rows, 1.0), rows @ rows[:30].T, []
    read = lists.read
    lists.read = lambda u, d, a, b: far.append(b) or read(u, d, a, b)
    for j in range(30):
        order = sorted((-s, i) for i, s in enumerate(exact[:, j].tolist()) if i != j)[:5]
        live, scores = lists.best(j, rows[j], -math.inf, 5)
        assert dict(zip(live.tolist(), scores.tolist(), strict=True)).items() >= {(i, int(-s)) for s, i in order}
        assert len(live) < 60
        assert far[0] == 1 and far == sorted(far)
        far.clear()
        live, _ = lists.best(j, rows[j], float(-order[0][0]), 5)
        assert order[0][1] in live and len(live) < 20
        far.clear()
        assert len(lists.best(j, rows[j], float(-order[0][0]) + 1, 5)[0]) == 0 and far[-1] < 3_000
        far.clear()


def test_box_bounds_hold():
    rng = np.random.default_rng(2)
    rows, queries = rng.integers(-400, 400, (300, 9)).astype(float), rng.integers(-400, 400, (20, 9)).astype(float)
    points = topk.METHOD.points(rows, 1.0)
    some = topk.most_in_boxes(queries, 1.0, points[None, :100].min(1), points[None, :100].max(1))
    assert (some[:, 0] >= (rows[:100] @ queries.T).max(0)).all()


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_on_full_blocks(spark, tmp_path, clustered):
    """Recall over several blocks of production size, on clusters and on noise, and few visits where clusters allow it."""
    rng = np.random.default_rng(9)
    n, d = 40_000, 32
    centres = rng.standard_normal((60, d))
    rows = (centres[rng.integers(0, 60, n)] + 0.25 * rng.standard_normal((n, d)) if clustered else rng.standard_normal((n, d))).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(rows), pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    some = ann.nearest(df, query_every=400)
    got = defaultdict(set)
    for r in some.collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, n, 400):
        s = rows.astype(float) @ rows[q].astype(float)
        s[q] = -9
        hits += len(got[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert len(got) == 100 and hits >= 0.9 * 2_000


def test_nearest(vectors):
    rows = usable(vectors, False)
    want = brute(rows, 20, 20, lambda a, b: float(ann.inner_products(b[None], a)[0]))
    got = ann.nearest(vectors, block_rows=200, query_rows=9).collect()
    lists = defaultdict(list)
    for r in got:
        lists[r.query_id].append((r.rank, r.vec_id, r.score))
    by = dict(rows)
    for q, found in lists.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(s == float(ann.inner_products(by[v][None], by[q])[0]) for _, v, s in found)
    hits = sum(((r.query_id, r.vec_id) in {(q, c) for q, _, c, _ in want}) for r in got)
    assert hits >= 0.9 * sum(want.values()) and len(got) == sum(want.values())
    assert ann.nearest(vectors.where("vec_id < 0")).count() == 0


def test_chi_square_and_leaves():
    assert ann.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3)
    points = np.random.default_rng(0).standard_normal((1000, 4))
    leaves = ann.kd_leaves(points, 32)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000)) and max(map(len, leaves)) <= 32


TRICKS = ["", None, r"\### Assistant: </turn> ok", "<turn>", r"<\turn>", r"<\\/turn/>", "<turn/>x</turn>", "a < b </turn", "<", "\\", "plain text with words", "x " * 900]


@pytest.fixture(scope="module")
def talks(spark):
    r = random.Random(3)
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2], r.choice(TRICKS)) for c in range(25) for t in range(r.randint(1, 14))]
    rows += [(50, t, ("user", "assistant")[t % 2], "many words here " * r.randint(1, 40)) for t in range(700)]
    rows += [(60, 1, "assistant", "same"), (60, 1, "assistant", "same"), (60, None, "user", "no turn"), (60, 1, None, "no role"), (None, 0, "assistant", "no conversation"), (61, 0, "</turn><turn/>", "odd role")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"tokens": F.lit("x"), "start": F.lit("y"), "window": F.lit("z"), "kind": F.lit("k")}), rows


def test_chat_round_trip(talks):
    df, rows = talks
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat.digests(chat.chat_windows(df)).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x for *_, role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for *_, role, x in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(learnt) and got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.chat_windows(df.where("conv_id = -99")).count() == 0


def test_windows_keep_budget_system_and_history(talks):
    df, rows = talks
    windows = chat.chat_windows(df, budget=512, history=96)
    longest = {(c): max(len((x or "").split()) for k, *_, x in rows if k == c) for c in {r[0] for r in rows}}
    system = {c: x or "" for c, t, role, x in rows if t == 0 and role == "system"}
    read = chat.read_windows(windows).join(windows.select("conv_id", "window", "tokens", "formatted", "repeated"), ["conv_id", "window"]).orderBy("conv_id", "window").collect()
    seen = set()
    for w in read:
        new = len(w.turns)
        assert new >= 1
        if longest[w.conv_id] < 150:
            assert w.tokens <= 512
        assert w.formatted.count(chat.CLOSE) == new + w.repeated
        if w.conv_id in system and w.conv_id in seen:
            assert w.formatted.startswith(chat.OPEN + "system" + chat.MIDDLE) and w.repeated >= 1
        seen.add(w.conv_id)
    assert any(w.repeated for w in read if w.conv_id == 50) and sum(len(w.turns) for w in read) == len([r for r in rows if r[0] is not None])


def test_chat_is_native(spark, talks):
    plan = chat.digests(chat.chat_windows(talks[0]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        n = r.randint(20, 80)
        text = " ".join(r.choice(["river", "stone", "cloud", "over", "under", "green", "walks", "slow"]) + r.choice(["", "s", "ed"]) for _ in range(n)) + "."
        bad = i % 5 == 4
        if bad:
            text = r.choice([" ".join(["Again"] * n), " ".join(w + "$$$" for w in text.split()), text.upper() + "!!", " | ".join(text.split())])
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 2:
            labels.append((i, int(not bad), 0))
    rows += [(5000, None, None, None, None), (5001, "", "en", "s0", 0), (5002, rows[0][1] + " tail", "en", "s1", 9), (5003, rows[0][1], "en", "s1", 9), (5003, rows[0][1], "en", "s1", 9), (5004, "write to ann@mail.example.org today " + rows[10][1], "en", "s2", 9)]
    labels += [(None, 1, 0), (3, None, 0), (5, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, corpus, messy):
    docs, labels = corpus
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 60
    scored = model.score(docs, "text", "score").select("doc_id", "score").collect()
    held = [r for r in scored if r.doc_id < 5000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= quality.THRESHOLD) == (r.doc_id % 5 != 4) for r in held)
    assert right >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in scored)
    other = model.score(messy, "text", "score")
    assert other.columns == messy.columns and other.where("score IS NULL").count() == 0
    assert model.score(docs.where("doc_id < 0"), "text", "score").count() == 0


def test_rules_against_plain_python(spark, corpus, messy):
    """The score as a column is the one that the kept rules give when they are gone through one by one."""
    docs, labels = corpus
    model = quality.train(docs, labels)
    space = set("\x20\x09\x0a\x0b\x0c\x0d")
    for df in (docs, messy):
        for r in model.score(df.select("text"), "text", "s").collect():
            t = r.text or ""
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
            cells, lines = re.split(r"[\x20\x09-\x0D]+", t), t.split("\n")
            n = {"chars": len(t), "words": len(words), "distinct": len(set(cells)), "lines": len(lines), "distinct_lines": len(set(lines))}
            n["repeats"] = sum(a == b for a, b in zip(words, words[1:], strict=False))
            n["symbols"], n["capitals"], n["digits"], n["commas"] = (sum(c in x for c in t) for x in ("!#$%&*+/<=>@\\^_`{|}~", string.ascii_uppercase, string.digits, ","))
            n["lone_symbols"] = sum(all(c in string.punctuation for c in w) for w in words)
            n["symbol_ends"] = len(re.findall(r"[A-Za-z.,][!#$%&*]+", t))
            n["stops"] = sum(c in ".?" and (i + 1 == len(t) or t[i + 1] in space) for i, c in enumerate(t))
            some = lambda k, n=n: max(n[k], 1)
            value = {"log_chars": math.log1p(n["chars"]), "log_words": math.log1p(n["words"]), "word_length": n["chars"] / some("words"), "distinct_words": math.log1p(n["distinct"]) / max(math.log1p(n["words"]), 1.0)}
            value |= {k: n[k] / some(by) for k, by in (("repeats", "words"), ("symbols", "chars"), ("lone_symbols", "words"), ("symbol_ends", "words"), ("capitals", "chars"), ("digits", "chars"), ("stops", "words"), ("commas", "words"), ("distinct_lines", "lines"))}
            value["words_per_line"] = n["words"] / some("lines")
            total = model.intercept + sum(rule.weight for rule in model.rules if all((value[k] > x) == above for k, above, x in rule.terms))
            assert r.s == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9), t[:80]


def test_quality_without_labels(corpus):
    docs, labels = corpus
    assert quality.train(docs, labels.where("quality > 5")).score(docs, "text", "s").where("s <> 0.5").count() == 0
    assert quality.train(docs, labels.where("quality = 1")).rules == ()


def test_tree_rules():
    tree = "Model\n  If (feature 0 <= 1.5)\n   If (feature 1 > 2.0E-4)\n    Predict: 0.0\n   Else (feature 1 <= 2.0E-4)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0"
    rules = [r.terms for r in quality.tree_rules(tree, ["a", "b"])]
    assert rules == [(("a", False, 1.5),), (("a", False, 1.5), ("b", True, 2.0e-4)), (("a", False, 1.5), ("b", False, 2.0e-4)), (("a", True, 1.5),)]


def test_pipeline_stages(spark, corpus, tmp_path):
    """Each stage does what its operator says to what the one before kept; all but the last keep the columns."""
    import corpus_pipeline

    docs, labels = corpus
    folder = str(tmp_path)
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    now = docs.withColumn("extra", F.col("doc_id") * 2)
    kept = pipeline.quality_stage(spark, now, folder)
    assert kept.columns == now.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len({i for i in range(900) if i % 5 != 4} - ids) < 30 and len({i for i in range(900) if i % 5 == 4} & ids) < 30
    one = pipeline.dedup_stage(spark, now, folder)
    assert one.columns == now.columns
    left = Counter(r.doc_id for r in one.select("doc_id").collect())
    assert left[0] == 1 and left[5003] == 0 and left[5002] == 0 and left[5000] == left[5001] == 1 and max(left.values()) == 1
    clean = pipeline.pii_stage(spark, now, folder)
    assert clean.columns == now.columns and clean.count() == now.count()
    row = clean.where("doc_id = 5004").first()
    assert "ann@" not in row.text and "[EMAIL]" in row.text and row.n_chars == len(row.text)
    mixed = pipeline.mixing_stage(spark, now, folder)
    assert mixed.columns == now.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 6
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    pieces = rows.collect()
    assert len(pieces) > 500 and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in pieces)


def test_stages_with_columns_of_their_own_names(spark, corpus, tmp_path):
    """Columns that are called as what stages add, in upper case too, come through untouched."""
    docs, labels = corpus
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = ["id", "hash", "doc", "words", "quality", "copies", "n", "all", "each", "rest", "__id", "__hash", "row_hash", "size", "chosen_id", "mix_id", "SCORE", "a.b"]
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for stage in (pipeline.quality_stage, pipeline.dedup_stage, pipeline.pii_stage, pipeline.mixing_stage):
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns
        assert out.where(F.col("doc_id").isNotNull() & (F.col("__id") != F.concat(F.lit("__id"), F.col("doc_id").cast("string")))).count() == 0 and out.count() > 0


def test_mixing_stage_takes_what_the_mix_says_of_repeated_rows(spark, corpus, tmp_path):
    docs, labels = corpus
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    some = docs.where("doc_id < 300").unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id = 2").withColumn("lang", F.lit("other")))
    rows = pipeline.mixing_stage(spark, some, str(tmp_path))
    count = lambda df: Counter({r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()})
    taken, size = count(rows), count(some)
    total, order = sum(size.values()), sorted(size)
    want = {s: min(3 * size[s], total * w / 8) for s, w in zip(order, (5, 2, 1), strict=True)}
    assert all(abs(taken[s] - want[s]) < 60 for s in order if want[s] < 3 * size[s])


def test_mixing_stage_keeps_sources_apart(spark, corpus, tmp_path):
    """Rows equal in id and text but from several sources get what the mix takes of each source's own."""
    docs, labels = corpus
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(1, "one row of two sources", s) for s in ("a", "b", "c")] + [(10 + i, f"words of source c {i} " * 40, "c") for i in range(40)]
    some = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    scored = pipeline.learnt(spark, str(tmp_path), None).score(some, "text", "quality")
    want = Counter({(r.source, r.doc_id): r.copies for r in mixing.mix_sources(scored, quality="quality").collect() if r.copies})
    got = Counter((r.source, r.doc_id) for r in pipeline.mixing_stage(spark, some, str(tmp_path)).select("source", "doc_id").collect())
    assert got == want and got["a", 1] == 3 and got["a", 1] != got["c", 1]


def test_pipeline_on_nothing(spark, corpus, tmp_path):
    import corpus_pipeline

    docs, labels = corpus
    docs.where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    labels.where("doc_id < 0").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_dedup_stage_keeps_unlinked_rows_of_null_and_repeated_ids(spark):
    text = lambda k, n=20: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(None, text(k)) for k in range(6)] + [(None, text(0))]  # six texts without an id, one of them twice
    rows += [(7, text(10)), (7, text(11)), (7, text(12)), (9, text(12)), (None, text(12))]  # one id on three unlinked texts
    rows += [(None, text(20, 60)), (None, text(20, 60) + " tail"), (8, ""), (8, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, pipeline.dedup_stage(spark, docs, "").collect()))
    near = [(None, text(20, 60)), (None, text(20, 60) + " tail")]
    assert sum(got.pop(x, 0) for x in near) == 1
    assert got == Counter([(None, text(k)) for k in range(6)] + [(7, text(k)) for k in (10, 11, 12)] + [(8, ""), (8, None), (None, None)])
