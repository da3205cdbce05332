"""Tables of keyed rows in buckets, of which an update rewrites only those that it touches; one manifest makes an update visible."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table. Its manifest keeps their number.
BUCKETS = 64
#: Bytes of a row group. A reader decodes thousands of rows of one at once, and a row may be all that a file tells.
ROW_GROUP = 8 << 20


class KeyedTable:
    """Rows by key in a folder that driver and executors share.

    A bucket holds the rows whose key's hash falls to it, as Parquet files in a folder of their own, which never changes. The manifest with the highest number
    names the folder of each bucket. An update writes new folders for the buckets of its keys, then the next manifest, in one step: a reader sees all of
    an update or nothing, and one that ends early leaves no trace. The manifest before stays, with its files, for its readers; older ones go. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets

    def _at(self, name: str = ""):
        """A path below the folder, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        path, files = self._at()
        return sorted(n for n in (f.getPath().getName() for f in files.listStatus(path)) if n.startswith(prefix)) if files.exists(path) else []

    def _manifests(self) -> list[dict]:
        """The manifests, oldest first."""
        out = []
        for name in self._names("manifest-"):
            path, files = self._at(name)
            stream = files.open(path)
            try:
                out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return out

    def _commit(self, manifest: dict) -> None:
        name = f"manifest-{manifest['number']:012d}.json"
        draft, files = self._at(f"draft-{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final = self._at(name)[0]
        if files.exists(final) or not files.rename(draft, final):
            raise RuntimeError(f"{final} is there already: another writer has updated the table")

    def _read(self, paths: list[str], tolerant: bool) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema)
        if tolerant:
            reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
            paths = [p for p in paths if self._at(p)[1].exists(self._at(p)[0])]
            if not paths:
                return self.spark.createDataFrame([], self.schema)
        return reader.parquet(*[f"{self.folder}/{p}" for p in paths])

    def load(self, tolerant: bool = False) -> DataFrame:
        """All rows. Files that cannot be read are an error; tolerant: their rows are missing."""
        found = self._manifests()
        return self._read(sorted(found[-1]["folders"].values()), tolerant) if found else self.spark.createDataFrame([], self.schema)

    def update(self, rows: DataFrame | None = None, gone: DataFrame | None = None, tolerant: bool = False) -> list[int]:
        """Put the rows in place of all rows of their keys, and remove the keys (column `key`) of gone; the buckets that were rewritten.

        rows and gone are read more than once. A bucket that is touched and cannot be read is an error, and the table stays as it was; tolerant: what can be
        read of it stays. Buckets that are not touched are neither read nor written.
        """
        found = self._manifests()
        last = found[-1] if found else {"number": -1, "buckets": self.buckets, "folders": {}}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(last["buckets"])).cast("int")
        keys = [d.select(self.key) for d in (rows, gone) if d is not None]
        if not keys:
            return []
        keys = keys[0].unionByName(keys[1]) if len(keys) == 2 else keys[0]
        touched = sorted(r.bucket for r in keys.select(bucket.alias("bucket")).distinct().collect())  # no more than there are buckets
        if not touched:
            return []
        held = self._read([p for b in touched if (p := last["folders"].get(str(b)))], tolerant)
        out = held.join(keys.distinct(), self.key, "left_anti").select(*held.columns)
        if rows is not None:
            out = out.unionByName(rows.select(*held.columns))
        name = f"data-{uuid.uuid4().hex}"
        out.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.partitionBy("bucket").option("parquet.block.size", ROW_GROUP).parquet(f"{self.folder}/{name}")
        folders = {b: p for b, p in last["folders"].items() if int(b) not in touched}
        for b in touched:
            path, files = self._at(f"{name}/bucket={b}")
            if files.exists(path):
                folders[str(b)] = f"{name}/bucket={b}"
        self._commit({"number": last["number"] + 1, "buckets": last["buckets"], "folders": folders})
        self._clean()
        return touched

    def _clean(self) -> None:
        """Remove what neither of the last two manifests names."""
        found = self._manifests()
        kept = {p for m in found[-2:] for p in m["folders"].values()}
        drop = self._names("draft-") + [f"manifest-{m['number']:012d}.json" for m in found[:-2]]
        for name in self._names("data-"):
            path, files = self._at(name)
            inner = [f"{name}/{f.getPath().getName()}" for f in files.listStatus(path) if f.isDirectory()]
            gone = [p for p in inner if p not in kept]
            drop += gone if len(gone) < len(inner) else [name]
        for name in drop:
            path, files = self._at(name)
            files.delete(path, True)

    def clear(self) -> None:
        path, files = self._at()
        files.delete(path, True)
