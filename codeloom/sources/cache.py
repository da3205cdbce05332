"""Stage A results by file, for analyses that parse only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import STAGE_A
from .keyed import BUCKETS, KeyedTable

KEY = "rel_file_path"
SCHEMA = f"mtime double, size long, {STAGE_A}"


def table(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, folder, SCHEMA, KEY, buckets)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The entries in a cache folder; none if it is not there. Entries that cannot be read are missing, so what they hold is parsed again by a caller who lists all files."""
    return table(spark, folder).load(tolerant=True)


def save(cache: DataFrame, folder: str) -> None:
    """Put entries in place of those of their files, and remove all others."""
    held = table(cache.sparkSession, folder)
    held.update(cache, purged(held.load(tolerant=True), cache).select(KEY), tolerant=True)


def split(files: DataFrame, cache: DataFrame, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) among files: a hit has an entry in the cache for its path, mtime and size. refresh: all are misses."""
    same = [files[KEY] == cache[KEY], files["mtime"] == cache["mtime"], files["size"] == cache["size"]]
    if refresh:
        return files.where(F.lit(False)), files
    return files.join(cache, same, "left_semi"), files.join(cache, same, "left_anti")


def purge(cache: DataFrame, files: DataFrame) -> DataFrame:
    """The cache without files that are gone."""
    return cache.join(files.select(KEY).distinct(), KEY, "left_semi")


def purged(cache: DataFrame, files: DataFrame) -> DataFrame:
    return cache.join(files.select(KEY).distinct(), KEY, "left_anti")
