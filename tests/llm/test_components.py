"""Components of chains, stars, cliques and random graphs."""

import random

import pytest

from detectlake.llm.components import connected_components


def roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


R = random.Random(2)
GRAPHS = {
    "chain": [(i, i + 1) for i in range(70)],
    "shuffled chain": [(a, b) for a, b in zip(*(lambda p: (p, p[1:]))(R.sample(range(1000), 60)), strict=False)],
    "star": [(500, i) for i in range(90)] + [(3, 3)],
    "clique": [(i, j) for i in range(12) for j in range(i)],
    "random": [(R.randrange(200), R.randrange(200)) for _ in range(120)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = GRAPHS[name]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    want = {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}
    assert sorted(map(tuple, got.collect())) == sorted(want.items())


def test_members_of_many_lists_meet_two_hubs(spark):
    """A dense group gives two candidates a member, not two for each list that holds it."""
    from pyspark.sql import functions as F

    from detectlake.llm.neardup import stars

    lists = spark.range(300).select(F.col("id").alias("cls"), F.explode(F.sequence(F.lit(0), F.lit(36))).alias("key")).where(F.xxhash64("cls", "key") % 3 != 0)
    hubs = lists.groupBy("key").agg(*(F.min(F.struct(F.xxhash64(F.lit(i), "cls"), "cls"))["cls"].alias(f"hub{i}") for i in (1, 2)))
    met = stars(lists.join(hubs, "key")).distinct()
    assert met.count() <= 600 and met.where("a >= b").isEmpty()
    assert met.select(F.explode(F.array("a", "b")).alias("cls")).distinct().count() == 300
