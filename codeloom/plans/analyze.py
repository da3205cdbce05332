"""From a source tree to a code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CodeGraph
from ..operators import extract, patterns, resolve
from ..runtime import cut
from ..sources import cache as cached
from ..sources import scan


def graph_of(stage_a: DataFrame) -> CodeGraph:
    """The graph of STAGE_A rows."""
    nodes, edges = resolve.resolve(stage_a)
    return CodeGraph(nodes, edges, extract.errors(stage_a), patterns.detect_patterns(stage_a, nodes), stage_a)


def analyze(spark: SparkSession, path: str, cache_folder: str | None = None, refresh: bool = False) -> tuple[CodeGraph, int, int]:
    """(graph, cache hits, misses) of a folder or file. With a cache folder, unchanged files are not parsed again, and files that are gone leave it."""
    files, problems = scan.scan(spark, path)
    if cache_folder is None:
        hits, misses = files.where(F.lit(False)), files
        fresh, kept = cut(extract.stage_a(scan.read_files(misses))), None
    else:
        cache = cached.load(spark, cache_folder)
        hits, misses = cached.split(files, cache, refresh)
        new = cut(extract.stage_a(scan.read_files(misses)).join(files.select("rel_file_path", "mtime", "size"), "rel_file_path"))
        kept = cache.join(hits.select("rel_file_path"), "rel_file_path", "left_semi").drop("file_seq").join(files.select("rel_file_path", "file_seq"), "rel_file_path")
        fresh = cut(kept.unionByName(new))
        # entries that could not be read are among the misses, so what can be read of their bucket may stay
        cached.table(spark, cache_folder).update(new, cached.purged(cache, files).select("rel_file_path"), tolerant=True)
    counts = hits.count(), misses.count()
    graph = graph_of(fresh)
    if problems:
        graph.errors = graph.errors.unionByName(spark.createDataFrame(problems, "file_path string, message string"))
    return graph, *counts
