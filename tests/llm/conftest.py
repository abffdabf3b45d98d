"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeats, clashing extra columns."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, copies string, label string, shard string, row string, part string, component_id string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeiou") for _ in range(r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    rows = [(i, words(i, 5 + 7 * (i % 9)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (None, "no id here " + words(7, 30), None, "s1"), (None, None, None, None)]
    rows += [(102, words(5, 40) + " tail", "en", "s2"), (103, words(5, 40) + " tail", "en", "s2"), (104, words(5, 40).upper() + " Tail", "en", None)]
    rows += [(105, "x" * 20_000, "en", "s3"), (106, words(9, 6_000), "de", "s3"), (107, " \t\n ", "en", "s0"), (108, "one two", "en", "s1"), (109, "One  TWO", "en", "s1")]
    rows += [(110, "repeated row with some words in it", "en", "s0")] * 3
    rows += [(111, "café ☃ \U0001f600 　 wide space <|endoftext|> a\n\n b", "fr", "é")]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    df = spark.createDataFrame(messy_rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in SCHEMA.split(", ")[5:]:
        name, kind = c.split()
        df = df.withColumn(name, F.lit("clash").cast("string") if kind == "string" else F.lit(9.0))
    return df.cache()


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("doc_id = -12345")
