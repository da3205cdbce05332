"""Numbers that follow an order over all rows, without a window over all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 0) in an order, as column `name`. Rows that are equal in the order are placed as they come.

    Rows are dealt to ranges of the order and sorted there; each range begins after the rows of those before, of which one count a range comes to the driver. Rows
    that are equal in the order share a range, so an order is to tell rows apart.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = cut(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    counts = {r["_part"]: r["count"] for r in held.groupBy("_part").count().collect()}
    starts = [0, *accumulate(counts.get(p, 0) for p in range(max(counts, default=0)))]
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_part") + 1)
    return held.withColumn(name, start + F.col("_at")).drop("_part", "_at")


def ordinals(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 0) in an order within their group, as column `name`. A group may hold any share of the rows."""
    placed = numbered(rows, [F.col(group), *order], "_n")
    first = placed.groupBy(F.col(group).alias("_of")).agg(F.min("_n").alias("_first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("_of"))).withColumn(name, F.col("_n") - F.col("_first")).drop("_of", "_first", "_n")
