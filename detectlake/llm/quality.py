"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on statistics of labelled texts; every path in them is a rule, a conjunction of
comparisons. A lasso logistic regression keeps few of the rules and weighs them, and the kept rules become
one column expression that scores a whole corpus without leaving the JVM.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fold_of, materialise, table

#: At most so many labelled rows are learnt from, by the order of a hash of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO = 24, 3, 0.001
THRESHOLD = 0.3


def counts(text: Column) -> dict[str, Column]:
    """What is counted in a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    lines = F.split(text, "\n")
    return {
        "chars": F.length(text),
        "words": count(WORD),
        "distinct": F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))),
        "repeats": count(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?=[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D]))"),
        "symbols": count(r"[!#$%&*+/<=>@\\^_`{|}~]"),
        "lone_symbols": count(r"(?<![^\x20\x09-\x0D])[!-/:-@\[-`{-~]+(?![^\x20\x09-\x0D])"),
        "symbol_ends": count(r"[A-Za-z.,][!#$%&*]+"),
        "capitals": count(r"[A-Z]"),
        "digits": count(r"[0-9]"),
        "stops": count(r"[.?](?=[\x20\x09-\x0D]|$)"),
        "commas": count(r","),
        "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)),
    }


def ratios(n: Mapping[str, Column]) -> dict[str, Column]:
    """The statistics that rules compare, from counts."""
    some = lambda c: F.greatest(n[c], F.lit(1)).cast("double")
    log = lambda c: F.log1p(n[c].cast("double"))
    return {
        "log_chars": log("chars"),
        "log_words": log("words"),
        "word_length": n["chars"] / some("words"),
        "distinct_words": log("distinct") / F.greatest(log("words"), F.lit(1.0)),
        "repeats": n["repeats"] / some("words"),
        "symbols": n["symbols"] / some("chars"),
        "lone_symbols": n["lone_symbols"] / some("words"),
        "symbol_ends": n["symbol_ends"] / some("words"),
        "capitals": n["capitals"] / some("chars"),
        "digits": n["digits"] / some("chars"),
        "stops": n["stops"] / some("words"),
        "commas": n["commas"] / some("words"),
        "words_per_line": n["words"] / some("lines"),
        "distinct_lines": n["distinct_lines"] / some("lines"),
    }


def statistics(text: Column) -> dict[str, Column]:
    return ratios(counts(text))


@dataclass(frozen=True)
class Rule:
    """Comparisons (statistic, whether above, threshold) that must all hold, and the weight if they do."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, statistic: dict[str, Column]) -> Column:
        found = F.lit(True)
        for name, above, threshold in self.terms:
            found = found & (statistic[name] > threshold if above else statistic[name] <= threshold)
        return found


def tree_rules(tree: str, names: list[str]) -> list[Rule]:
    """The rules of one tree: the path to every node but the root, from the tree's printed form."""
    rules, path = [], []
    for line in tree.splitlines():
        if not (m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)):
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth] + [(depth, (names[int(m[2])], m[3] == ">", float(m[4])))]
        rules.append(Rule(tuple(x[1] for x in path)))
    return rules


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; ``score`` is a column expression over a text."""

    intercept: float
    rules: tuple[Rule, ...]

    def score(self, docs: DataFrame, text: str, into: str) -> DataFrame:
        """Adds the column ``into``, from 0 to 1; all other columns stay as they are.

        Null text counts as empty, and an empty text is scored by its statistics like any other; texts of any
        length are read whole. Equal texts get equal scores, repeated rows a row each, an empty table none.

        Everything is counted once, in a struct that the rules see as a lambda's variable: a filter on the
        score that is pushed below it then doesn't repeat the counts for every comparison.
        """
        found = counts(F.col(text))

        def total(n: Column) -> Column:
            values = ratios({k: n[k] for k in found})
            sum_ = F.lit(self.intercept)
            for rule in self.rules:
                sum_ = sum_ + F.when(rule.holds(values), F.lit(rule.weight)).otherwise(F.lit(0.0))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum_))

        return docs.withColumn(into, F.transform(F.array(F.struct(*(v.alias(k) for k, v in found.items()))), total)[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and label of at most ``rows`` labelled documents, none of them held out.

    Several labels of a document count as their highest; null ids and labels are left out.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg((F.max("quality") > 0).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    return picked.select("label", F.array(*(v.cast("double") for v in statistics(F.col("text")).values())).alias("values"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 1) -> RuleModel:
    """Grow trees, take their paths as rules, weigh and select the rules by lasso.

    Without labels, or with one class only, the model is a constant: 0.5, or the smoothed share of label 1.
    """
    sample = materialise(labelled_sample(docs, labels, rows), "labelled").cache()
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return RuleModel(math.log((ones + 1) / (n - ones + 1)), ())
    names = list(statistics(F.lit("")))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, featureSubsetStrategy="0.5", seed=seed)
    grown = forest.fit(sample.select("label", array_to_vector("values").alias("features")))
    rules = list(dict.fromkeys(r for tree in grown.trees for r in tree_rules(tree.toDebugString, names)))
    value = {k: F.col("values")[i] for i, k in enumerate(names)}
    holds = F.array(*(F.when(r.holds(value), 1.0).otherwise(0.0) for r in rules))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60)
    fitted = lasso.fit(sample.select("label", array_to_vector(holds).alias("features")))
    sample.unpersist()
    kept = tuple(Rule(r.terms, float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if abs(w) > 1e-6)
    return RuleModel(float(fitted.intercept), kept)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = train(docs, table(spark, sf_dir, "labels")).score(docs, "text", "score")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
