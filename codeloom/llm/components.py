"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")).withColumnRenamed("a", "of")
    return both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of")
    joined = down.join(least, F.col("a") == F.col("of"))
    moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, root (the least node of its component) of each node that a row (a, b) of links joins to another, other than roots.

    Each round is two joins on the links, written to the scratch folder; rounds grow with the logarithm of a component's size. The
    links of a hot node are not gathered: its least neighbour is an aggregate, and the join is one that Spark splits.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    edges, before = scratch.table(links.select("a", "b").where("a != b").distinct(), "edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        edges = scratch.table(_small_star(_large_star(edges)), "edges")
