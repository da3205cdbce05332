"""A registry of models as a table: id, provider, name, model, key, enabled, default_chat, default_architecture, seq."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask_key

SCHEMA = "seq long, id string, provider string, name string, model string, key string, enabled boolean, default_chat boolean, default_architecture boolean"
FEATURES = {"chat": "default_chat", "architecture": "default_architecture"}


def enabled_only(models: DataFrame) -> DataFrame:
    return models.where("enabled")


def public(models: DataFrame) -> DataFrame:
    """The models without their keys: whether there is one, and its ends."""
    return models.withColumns({"has_key": F.coalesce(F.col("key") != "", F.lit(False)), "masked_key": mask_key(F.col("key"))}).drop("key")


def upsert(models: DataFrame, new: DataFrame) -> DataFrame:
    """models with the rows of new put in by id: a row without a key keeps the old one; a default that it claims, all others lose."""
    old = models.select(F.col("id").alias("old_id"), F.col("key").alias("old_key"), F.col("seq").alias("old_seq"))
    last = models.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    put = new.join(old, F.col("id") == F.col("old_id"), "left").crossJoin(last)  # last is one row
    put = put.withColumn("key", F.when(F.coalesce("key", F.lit("")) != "", F.col("key")).otherwise(F.col("old_key"))).withColumn("seq", F.coalesce("old_seq", F.col("last") + 1 + F.col("seq"))).drop("old_id", "old_key", "old_seq", "last")
    out = models.join(new.select("id"), "id", "left_anti").withColumn("claimed", F.lit(0)).unionByName(put.withColumn("claimed", F.lit(1)))
    claims = put.agg(*[F.coalesce(F.max(c), F.lit(False)).alias(f"any_{c}") for c in FEATURES.values()])
    out = out.crossJoin(claims)  # one row
    for c in FEATURES.values():
        out = out.withColumn(c, F.when(F.col(f"any_{c}") & (F.col("claimed") == 0), False).otherwise(F.col(c)))
    return out.drop("claimed", *[f"any_{c}" for c in FEATURES.values()])


def delete(models: DataFrame, gone: DataFrame) -> DataFrame:
    """models without the ids of gone; a default that nobody has then goes to the first left."""
    left = models.join(gone.select("id"), "id", "left_anti")
    state = left.agg(F.min("seq").alias("first_seq"), *[F.coalesce(F.max(c), F.lit(False)).alias(f"any_{c}") for c in FEATURES.values()])
    out = left.crossJoin(state)  # one row
    for c in FEATURES.values():
        out = out.withColumn(c, F.when(F.col(f"any_{c}"), F.col(c)).otherwise(F.col("seq") == F.col("first_seq")))
    return out.drop("first_seq", *[f"any_{c}" for c in FEATURES.values()])


def set_default(models: DataFrame, model_id: str, target: str) -> DataFrame:
    """target: chat, architecture or both."""
    out = models
    for name, c in FEATURES.items():
        if target in (name, "both"):
            out = out.withColumn(c, F.col("id") == model_id)
    return out


def resolve(models: DataFrame, requests: DataFrame) -> DataFrame:
    """request, id: of the enabled models, the one asked for (wanted, may be null), else the default of the feature, else the first."""
    live = models.where("enabled")
    asked = requests.join(live.select(F.col("id").alias("asked")), F.col("wanted") == F.col("asked"), "left")
    best = live.agg(*[F.coalesce(F.min_by("id", F.when(F.col(c), F.col("seq"))), F.min_by("id", "seq")).alias(f) for f, c in FEATURES.items()])
    out = asked.crossJoin(best)  # one row
    return out.select("request", F.coalesce("asked", F.when(F.col("feature") == "chat", F.col("chat")).otherwise(F.col("architecture"))).alias("id")).where("id IS NOT NULL")
