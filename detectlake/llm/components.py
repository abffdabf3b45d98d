"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def star_round(edges: DataFrame) -> DataFrame:
    """The edges (a, b) after one round: a node's larger neighbours hang on its smallest one, then its smaller ones too.

    The components stay what they were. Minima are partial aggregates, so a node with very many edges doesn't
    gather in one task. The edges are written to the shared folder.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    small = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return materialise(small.where(F.col("a") != F.col("b")).distinct(), "edges")


def are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, on which nothing depends that hangs itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").isEmpty()


def star_edges(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The edges (a, b), a > b, of a star round by round, until they are stars (Kiveris et al., 2014); the number of rounds grows with the logarithm of the size."""
    for _ in range(rounds):
        if are_stars(edges):
            return edges
        edges = star_round(edges)
    raise RuntimeError("components did not settle")


def hung(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes that edges (a, b) of rounds hang on smaller ones; all others are roots, as far as is known."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def tied(edges: DataFrame, links: DataFrame) -> DataFrame:
    """The edges of rounds after further links (a, b), which tie the roots of their ends, and one more round."""
    for side in "ab":
        links = links.join(hung(edges).select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return star_round(edges.unionByName(links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component."""
    edges = star_edges(star_round(edges))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
