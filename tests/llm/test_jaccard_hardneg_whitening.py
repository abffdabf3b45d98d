"""The Jaccard join, hard negatives and whitening against brute force, on awkward rows and on none."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from detectlake.llm import hardneg, jaccard, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(rows, words, percent):
    """(doc_id, set size, component) by comparing all pairs of rows."""
    sets, ids = [], []
    for doc_id, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
        ids.append(doc_id)
    index = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), max(1, len(index))), np.float32)
    for i, s in enumerate(sets):
        m[i, [index[g] for g in s]] = 1
    both, size = m @ m.T, m.sum(1)
    linked = (100 * both >= percent * (size[:, None] + size[None] - both)) & (size[:, None] > 0) & (size[None] > 0)
    name = np.arange(len(rows))
    while (lower := np.where(linked | np.eye(len(rows), dtype=bool), name[None], len(rows)).min(1)).tolist() != name.tolist():
        name = lower
    least = {}
    for i, n in enumerate(name.tolist()):
        least[n] = min((x for x in (least.get(n), ids[i]) if x is not None), default=None)
    return Counter((ids[i], len(sets[i]), least[n]) for i, n in enumerate(name.tolist()))


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_on_awkward_rows(messy, messy_rows, nothing, words, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(messy, words, percent).collect())
    assert got == components([r[:2] for r in messy_rows], words, percent)
    if words == 3:
        assert jaccard.jaccard_components(nothing).count() == 0


def varied(rng, base, edits):
    t = list(base)
    for _ in range(edits):
        t[rng.integers(len(t))] = f"x{rng.integers(1 << 40)}"
    return " ".join(t)


@pytest.mark.parametrize("long_column", [4, 16])
def test_jaccard_of_copies_and_shared_passages(spark, monkeypatch, long_column):
    """Groups of copies around the bound, chains, passages that all share, sets of a few n-grams."""
    monkeypatch.setattr(jaccard, "LONG_COLUMN", long_column)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    texts = []
    for size, edits in ((120, 1), (120, 2), (60, 1), (300, 5), (12, 1)):
        base = word(size)
        texts += [varied(rng, base, int(rng.integers(0, edits + 1))) for _ in range(60)]
    passage = " ".join(word(80))
    texts += [passage + " " + " ".join(word(int(rng.integers(1, 30)))) for _ in range(80)]
    chain = word(200)
    for i in range(30):  # each is near the one before, not the first
        chain = chain[3:] + word(3)
        texts.append(" ".join(chain))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == components(rows, 3, 90)


def test_jaccard_pairs_grow_in_proportion(spark, monkeypatch):
    """In groups of copies around the bound, what is made of pairs and postings grows as the copies do."""
    from detectlake.llm import neardup

    made, n = Counter(), 0
    for module in (jaccard, neardup):
        write = module.materialise

        def count(df, name, write=write):
            out = write(df, name)
            if name in ("candidates", "near", "met", "links", "mixed", "across", "entries"):
                made[name, n] += out.count()
            return out

        monkeypatch.setattr(module, "materialise", count)
    for n in (300, 900):
        rng = np.random.default_rng(3)
        base = [f"w{x}" for x in rng.integers(0, 400, 120)]
        rows = [(i, varied(rng, base, 2)) for i in range(n)]
        found = {r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
        assert found == {x[2] for x in components(rows, 3, 90)}
    for name in {x for x, _ in made}:
        # in proportion, or few against the rows
        assert made[name, 900] < 4.2 * max(made[name, 300], 300), (name, made)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((4, 8)) * 3
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(8) + centres[i % 4] * (i % 3 > 0))], int(i % 5)) for i in range(900)]
    rows += [(2000 + i, rows[100][1], i % 3) for i in range(60)]  # ties
    rows += [(2100, None, 1), (2101, [0.0] * 8, 1), (2200, [0.0] * 8, 2), (2300, [], 1), (2400, rows[7][1], None), (None, rows[7][1], 1), (2500, [float("nan")] * 8, 0), (2600, [None] + [1.0] * 7, 0), (2700, [1.0, 2.0], 1), (2701, [2.0, 2.0], 1), (2702, [1.9, 1.9], 3), (2702, [1.9, 1.9], 3), (300, rows[300][1], 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"row": F.lit("x"), "v": F.lit(1), "dim": F.lit("y"), "score": F.lit(0.5), "cell": F.lit(3), "rank": F.lit(1)})


def mined(df, k=5):
    rows = []
    for r in df.select("vec_id", "embedding", "label").collect():
        v = r.embedding
        if r.vec_id is not None and r.label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(v, np.float64)).astype(int)))
    out = Counter()
    for a, label, x in rows:
        if a % 100 == 0:
            scored = sorted((-int(x @ y), c, own) for c, own, y in rows if c != a and len(y) == len(x))
            for s, p, _ in [t for t in scored if t[2] == label][:k]:
                hard = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:k]
                out.update((a, p, i + 1, c, -s, -n) for i, (n, c, _) in enumerate(hard))
    return out


@pytest.mark.parametrize(("block", "queries"), [(16_384, 65_536), (50, 3)])
def test_hard_negatives(labelled, block, queries):
    want = mined(labelled)
    assert len(want) > 50
    assert Counter(map(tuple, hardneg.hard_negatives(labelled, block_rows=block, query_rows=queries).collect())) == want
    assert hardneg.hard_negatives(labelled.where("vec_id < 0")).count() == 0


def test_few_candidates_and_large_components(spark):
    big = float(2**22)
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (100, [big, big], 2), (101, [big, 0.5], 2), (102, [big, 0.25], 3), (103, [big * 0.9, 0.0], 3)], "vec_id long, embedding array<double>, label int")
    assert Counter(map(tuple, hardneg.hard_negatives(df).collect())) == mined(df)
    assert hardneg.hard_negatives(df.where("vec_id = 0")).count() == 0


def test_score_intervals_hold_all_rows():
    """No row scores outside of its leaf's interval, and overlapping() keeps all rows within a window."""
    rng = np.random.default_rng(2)
    rows = np.floor(rng.standard_normal((500, 6)) * 200)
    rows[:50] = rows[0]
    references = hardneg.spread_references(rows[40:90])
    angles = hardneg.angles_to(rows, references)
    queries = np.vstack([rows[:5], -rows[7:9], rows[60:90] * 3])
    theirs, length = hardneg.angles_to(queries, references), np.linalg.norm(queries, axis=1)
    leaf = np.arange(500) // 25
    ends = [f(x[leaf == i], 0) for i in range(20) for f, x in ((np.min, angles), (np.max, angles))]
    norm = np.linalg.norm(rows, axis=1)
    known = hardneg.Leaves(np.arange(20), np.array(ends[::2]), np.array(ends[1::2]), np.array([norm[leaf == i].min() for i in range(20)]), np.array([norm[leaf == i].max() for i in range(20)]))
    low, high = known.scores(theirs, length)
    exact = queries @ rows.T
    assert (low[:, leaf] <= exact).all() and (exact <= high[:, leaf]).all()
    block = hardneg.Block(np.arange(500), np.zeros(500, int), rows, angles, 3)
    for q in range(len(queries)):
        for floor, roof in ((-np.inf, np.inf), (np.quantile(exact[q], 0.9), np.inf), (np.quantile(exact[q], 0.7), np.quantile(exact[q], 0.95))):
            found = block.ids[block.overlapping(theirs[q], float(length[q]), float(floor), float(roof))]
            assert set(np.flatnonzero((exact[q] >= floor) & (exact[q] <= roof))) <= set(found.tolist())


def by_hand(x, components):
    """n, exact deviations, whitened values and shares by a dense eigenvalue routine."""
    n, s = len(x), x.sum(0)
    y = n * x - s
    v = (y / n).T @ (y / n) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    keep = e > 1e-10 * max(e[0], 1e-300)
    return n, (y * y).sum(1), (y / n) @ q[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(v)


def compare(df, found, components=32, spread=1e-9):
    rows = [(r.vec_id, np.floor(64 * np.array(r.embedding, np.float64)).astype(np.int64) + 1_000_000) for r in df.collect()]
    n, deviation, w, share = by_hand(np.array([x for _, x in rows]), components)
    got = {}
    for r in found.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows) and all(sorted(x) == list(range(1, w.shape[1] + 1)) for x in got.values())
    m = np.array([[got[i][c + 1].whitened for c in range(w.shape[1])] for i, _ in rows])
    assert np.abs(m * np.sign((m * w).sum(0)) - w).max() < spread
    assert all(got[i][1].deviation == d and got[i][1].n == n for (i, _), d in zip(rows, deviation.tolist(), strict=True))
    assert all(abs(got[rows[0][0]][c + 1].explained / share[c] - 1) < 1e-9 for c in range(len(share)))
    assert len({r.identity_error for x in got.values() for r in x.values()}) == 1 and next(iter(got.values()))[1].identity_error < 1e-9


@pytest.mark.parametrize("kind", ["flat", "falling", "narrow", "deficient"])
def test_whitening(spark, kind):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((700, 6 if kind == "narrow" else 48))
    if kind == "falling":
        x = x * 50 * 0.8 ** np.arange(48) + 0.1 * x
    if kind == "deficient":
        x = np.floor(x[:, :9]) @ rng.integers(-3, 4, (9, 48))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    if kind == "deficient":
        found = whitening.whitened(df)
        assert found.agg(F.max("component"), F.max("identity_error")).first()[0] == 9
        compare(df, found)
    else:
        compare(df, whitening.whitened(df, 8 if kind == "falling" else 32), 8 if kind == "falling" else 32)


def test_whitening_takes_awkward_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, v) for i, v in enumerate(rng.standard_normal((90, 5)).tolist())]
    bad = [(200, None), (201, [float("nan")] * 5), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("inf")] * 5), (204, [])]
    schema = "vec_id long, embedding array<double>, n string, component string, x string, dim string"
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in good + bad + [(None, good[3][1]), (7, good[7][1])]], schema)
    found = whitening.whitened(df).collect()
    assert Counter(r.vec_id for r in found) == Counter({**{i: 5 for i, _ in good}, None: 5, 7: 10})
    assert {r.n for r in found} == {92} and max(r.identity_error for r in found) < 1e-9
    # a length of its own has a fit of its own; one vector, or equal ones, have no spread
    mixed = spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(round(r.whitened, 9))) for r in whitening.whitened(mixed).collect()) == [(1, 1, 2, 128**2, 1.0), (2, 1, 2, 128**2, 1.0)]
    assert whitening.whitened(df.where("vec_id < 0")).count() == 0


def test_leading_finds_what_a_block_misses():
    """Eigenpairs of spectra with gaps, ties and no gap, by passes alone."""
    rng = np.random.default_rng(0)
    for values in (np.linspace(10, 9, 80), np.repeat([5.0, 3.0, 1.0], [30, 20, 30]), 0.5 ** np.arange(80.0), np.r_[np.ones(79), 1e6]):
        q = np.linalg.qr(rng.standard_normal((80, 80)))[0]
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        found, vectors = whitening.leading(lambda x, a=a: a @ x, 80, 24)
        want = np.sort(values)[::-1][:24]
        assert np.abs(found - want).max() < 1e-11 * want[0] and np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-12
