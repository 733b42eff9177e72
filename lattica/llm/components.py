"""Connected components by alternating large-star and small-star steps, all relational."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """`edges` run from the larger node `a` to the smaller `b`."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least.withColumnRenamed("a", "c"), F.col("a") == F.col("c"))
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m").toDF("a", "b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b, of one type, no nulls): root is the least node it reaches.

    A node with many neighbours is only ever met by a partial minimum and by a join whose hot side Spark splits.
    Loops and repeated edges are harmless; no edges give no rows. `rounds` only guards against a defect: stars settle
    in a number of rounds that grows with the logarithm of the longest path, and an unsettled result is an error.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        edges = cut(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
