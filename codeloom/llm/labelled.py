"""A bounded, repeatable sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """text, label (0 or 1) of at most `most` labelled rows outside the fold held_out, by order of a hash of doc_id.

    Labels other than 0 and 1 are ignored. The sample's ids, at most `most`, are broadcast. Of rows that repeat a doc_id, the least text
    counts, so that rows are no more than ids.
    """
    ids = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out)).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).alias("label"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    return rows.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")
