"""Design patterns: what files tell of singletons and observers, and factories, which need the project's classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import EVIDENCE, exploded, sequence


def factories(a: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """seq, symbol_id of callables with an if chain of which two branches return calls of two different project classes."""
    classes = all_nodes.where("kind = 'class'")
    known = classes.select(F.col("name").alias("n")).unionByName(classes.select(F.col("id").alias("n"))).distinct()
    branches = exploded(a, "branches").join(known.select(F.col("n").alias("whole")), F.col("dotted") == F.col("whole"), "left").join(known.select(F.col("n").alias("last")), F.col("short") == F.col("last"), "left")
    branches = branches.withColumn("cls", F.coalesce("whole", "last")).where("cls IS NOT NULL")
    chains = branches.groupBy("file_seq", "pos", "symbol_id", "chain_no").agg(F.count_distinct("branch_no").alias("b"), F.count_distinct("cls").alias("c"))
    return chains.where("b >= 2 AND c >= 2").select(sequence(F.col("file_seq"), F.col("pos")).alias("seq"), "symbol_id").distinct()


def detect_patterns(a: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """seq, pattern, symbol_id, evidence; in order of seq, a Singleton before an Observer."""
    own = exploded(a, "patterns").select(sequence(F.col("file_seq"), F.col("pos")).alias("seq"), "pattern", "symbol_id")
    rows = own.unionByName(factories(a, all_nodes).select("seq", F.lit("Factory").alias("pattern"), "symbol_id"))
    said = F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair])
    return rows.withColumn("evidence", said[F.col("pattern")])
