"""A stream of source files: each batch parses its files and replaces their rows of the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract
from ..runtime import cut
from ..sources import cache as cached


def follow(files: DataFrame, cache_folder: str, checkpoint: str, buckets: int = cached.BUCKETS, **trigger) -> StreamingQuery:
    """files: a stream of file_seq, rel_file_path, module_path, mtime, size, content. Of files that repeat in a batch, the latest mtime counts.

    A batch rewrites the buckets of its own files alone, and a batch that runs again gives the same table. A bucket that it has to rewrite and cannot
    read stops the stream, for what it held would not come again.
    """

    def put(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("rel_file_path").agg(F.max_by(F.struct("file_seq", "module_path", "size", "content", "mtime"), "mtime").alias("f")).select("rel_file_path", "f.*")
        new = extract.stage_a(latest).join(latest.select("rel_file_path", "mtime", "size"), "rel_file_path")
        cached.table(batch.sparkSession, cache_folder, buckets).update(cut(new))

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
