"""What the check of the third round asked of the near-duplicate operators: pairs and sets in proportion to classes."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from detectlake.llm import components, jaccard, neardup


def test_a_class_in_many_lists_meets_few_others(spark):
    """Pairs between components follow the classes, not the lists that hold them; the component that most lists share is met first."""
    own = spark.range(200).select(F.col("id").alias("cls"), F.when(F.col("id") < 80, 0).otherwise(F.col("id")).alias("root"))
    named = own.select("cls", "root", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("key")).where(F.xxhash64("cls", "key") % 3 != 0)
    met = neardup.between_components(named, 0)
    assert met.count() <= 4 * 200 and met.where("a >= b or b < 80").isEmpty()
    assert met.where("a < 80 and b >= 80").select("b").distinct().count() == 120


@pytest.mark.parametrize("components", [lambda df: neardup.near_duplicates(df, 3, 85), lambda df: jaccard.jaccard_components(df, 3, 90)])
def test_sets_are_made_of_classes_that_may_be_linked(spark, monkeypatch, components):
    """Texts that share a passage but are of other sizes or have little else in common give candidates, and no whole sets."""
    passage, made = " ".join(f"p{i}" for i in range(60)), Counter()
    rows = [(i, f"{passage} " + " ".join(f"q{i}_{j}" for j in range(30 + i % 40))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"r{j}" for j in range(100)) + f" tail{i}") for i in range(10)]
    write = neardup.materialise

    def count(df, name):
        out = write(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(neardup, "materialise", count)
    got = components(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("component_id").count().where("count > 1").collect()
    assert [tuple(x) for x in got] == [(1000, 10)]
    assert made["sets"] <= 10


def test_copies_in_short_lists_meet_by_component(spark, monkeypatch):
    """Groups whose lists are all short: a member that hubs have joined to its group isn't compared with all others."""
    made, write = Counter(), neardup.materialise

    def count(df, name):
        out = write(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(neardup, "materialise", count)
    rows = [(8 * g + k, " ".join(f"g{g}_{j}" for j in range(150)) + f" end{g}_{k}") for g in range(40) for k in range(8)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert got.where("component_id <> doc_id - doc_id % 8").isEmpty()
    # all pairs of a group would be 28 for its 8 members
    assert made["candidates"] <= 2.5 * len(rows)


@pytest.mark.parametrize("sent", [0, 10_000])
def test_texts_that_are_not_asked_for_stay(spark, monkeypatch, sent):
    """However many rows are asked for, texts are left out by their marks before a shuffle, and the sets are those of the rows."""
    monkeypatch.setattr(neardup, "SENT", sent)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(3 + i % 5))) for i in range(500)] * 2, "doc_id long, text string")
    keyed = docs.select("doc_id", neardup.row_hash().alias("row_hash"), neardup.row_check().alias("row_check")).distinct()
    classes = keyed.select(F.col("doc_id").alias("cls"), F.struct("doc_id", "row_hash", "row_check").alias("rep"))
    asked = classes.where("cls % 50 = 7")
    kept = neardup.marked(keyed, asked.select("rep.row_hash", "rep.row_check"))
    assert asked.count() == 10 and asked.join(kept, F.col("doc_id") == F.col("cls")).count() == 10 and kept.count() <= 12
    sets = neardup.WholeSets(classes, docs, 3)
    assert sorted((x.cls, len(x.shingles)) for x in sets.of(asked).collect()) == [(i, 8 * (1 + i % 5)) for i in range(7, 500, 50)]
    assert sets.of(classes).count() == 500


def test_stars_that_no_round_needs_are_not_made(spark, monkeypatch):
    """One round of stars follows a round of pairs: until they are whole they are made at the end only, and not without pairs."""
    made, write = Counter(), components.materialise

    def count(df, name):
        made[name] += 1
        return write(df, name)

    monkeypatch.setattr(components, "materialise", count)
    rows = [(8 * g + k, " ".join(f"g{g}_{j}" for j in range(150)) + f" end{g}_{k}") for g in range(40) for k in range(8)]
    for found in (neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85), jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)):
        assert found.where("component_id <> doc_id - doc_id % 8").isEmpty()
    assert made["edges"] <= 6
