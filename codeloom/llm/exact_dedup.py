"""Exact deduplication: static binary-fuse filters screen an incoming batch against immutable snapshots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, keys64, mix64, table

#: Digests of one filter; a shard is a range of digests, so that shards are even whatever the texts are.
SHARD_ROWS = 1 << 19
#: Ids of texts to compare that a join may broadcast, 8 bytes each; with more, the texts are shuffled.
FEW_IDS = 500_000


class FuseFilter:
    """A static three-wise binary fuse filter of distinct 64-bit keys: 16 bits a slot, about 1.2 slots a key, no false negatives."""

    def __init__(self, seed: int, segment: int, segments: int, slots: np.ndarray):
        self.seed, self.segment, self.segments, self.slots = seed, segment, segments, slots

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        window = ((h >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64)
        places = np.stack([(window + i) * self.segment + ((h >> np.uint64(s)) & np.uint64(self.segment - 1)).astype(np.int64) for i, s in enumerate((0, 10, 20))])
        if self.segment > 1 << 10:  # longer segments need more bits than the slices of h have
            g = mix64(h)
            places = np.stack([(window + i) * self.segment + ((g >> np.uint64(s)) & np.uint64(self.segment - 1)).astype(np.int64) for i, s in enumerate((0, 21, 42))])
        return places, (mix64(h + np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel the keys' hypergraph in rounds of slots with a single key, then fill the slots in reverse."""
        keys = np.unique(keys)
        n = len(keys)
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        slots = max(1, int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) + 8)
        for seed in range(1, 200):
            f = cls(seed, segment, max(1, -(-slots // segment)), np.zeros(0, np.uint16))
            size = (f.segments + 2) * segment
            places, prints = f._place(keys)
            count = np.bincount(places.ravel(), minlength=size)
            owner = np.zeros(size, np.int64)
            for p in places:
                np.bitwise_xor.at(owner, p, np.arange(n))
            alive, rounds = np.ones(n, bool), []
            single = np.flatnonzero(count == 1)
            while len(single):
                key, at = np.unique(owner[single], return_index=True)
                rounds.append((key, single[at]))
                alive[key] = False
                touched = places[:, key].ravel()
                np.subtract.at(count, touched, 1)
                np.bitwise_xor.at(owner, touched, np.tile(key, 3))
                touched = np.unique(touched)
                single = touched[count[touched] == 1]
            if not alive.any():
                f.slots = np.zeros(size, np.uint16)
                for key, at in reversed(rounds):
                    p = places[:, key]
                    f.slots[at] = prints[key] ^ f.slots[p[0]] ^ f.slots[p[1]] ^ f.slots[p[2]]
                return f
            slots += slots // 16 + 1
        raise ValueError("no seed peels these keys")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        p, prints = self._place(keys)
        return self.slots[p[0]] ^ self.slots[p[1]] ^ self.slots[p[2]] == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> FuseFilter:
        return cls(*map(int, np.frombuffer(raw, np.int64, 3)), np.frombuffer(raw, np.uint16, offset=24))


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the original), n_bytes, digest (SHA-256 of the normalised text in hex) of each row."""
    own = normalised(F.col("text"))
    return docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.octet_length(own).cast("long").alias("n_bytes"), F.sha2(own, 256).alias("digest"))


def _key(digest: pd.Series) -> np.ndarray:
    return np.array([int(x[:16], 16) for x in digest], np.uint64)


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.substring("digest", 17, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def snapshot_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """shard, filter: one filter per shard of an immutable snapshot's distinct digests."""

    def build(of: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": of["shard"].iloc[:1], "filter": [FuseFilter.build(_key(of["digest"])).to_bytes()]})

    return snapshot.select("digest").distinct().withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def screen(batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The distinct digests of a batch that a snapshot may hold."""

    def probe(of: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        if by.empty or of.empty:
            return pd.DataFrame({"digest": pd.Series([], dtype=str)})
        return of.loc[FuseFilter.from_bytes(by["filter"].iloc[0]).holds(_key(of["digest"])), ["digest"]]

    own = batch.select("digest").distinct().withColumn("shard", _shard(shards))
    return own.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "digest string")


def dedup_batch(batch_docs: DataFrame, snapshot_docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digest rows of the batch, digest rows of the snapshot, digests of texts that both hold).

    Filters built once per snapshot screen the batch's distinct digests; what passes is joined with the snapshot's exact digests,
    and one text of each side is compared byte by byte, so that neither a filter's false positive nor a digest's collision counts.
    """
    # rows are numbered as they are written
    numbered = lambda docs, name: table(digests(docs).withColumn("row", F.monotonically_increasing_id()), name)
    batch, held = numbered(batch_docs, "dedup-batch"), numbered(snapshot_docs, "dedup-snapshot")
    shards = max(1, -(-max(held.count(), batch.count()) // SHARD_ROWS))
    filters = table(snapshot_filters(held, shards), "dedup-filters")
    positive = table(screen(batch, filters, shards), "dedup-positive")
    # exact buckets: one row of each side stands for a digest
    some_id = F.coalesce("doc_id", F.lit(-1 << 63))
    one = lambda rows, name: rows.groupBy("digest").agg(F.min(some_id).alias(name))
    pairs = positive.join(one(batch, "new_id"), "digest").join(one(held, "old_id"), "digest")
    texts = lambda docs, name: docs.select(some_id.alias(name), normalised(F.col("text")).alias(f"{name}_text"), F.sha2(normalised(F.col("text")), 256).alias("digest"))
    pairs = table(pairs, "dedup-pairs")
    few = pairs.count() <= FEW_IDS

    def needed(docs: DataFrame, name: str) -> DataFrame:
        ids = pairs.select(F.col(name).alias("needed")).distinct()
        return docs.join(F.broadcast(ids) if few else ids, some_id == F.col("needed"), "left_semi")

    # of rows that repeat a doc_id, the one with the digest's text is meant
    checked = pairs.join(texts(needed(batch_docs, "new_id"), "new_id"), ["new_id", "digest"]).join(texts(needed(snapshot_docs, "old_id"), "old_id"), ["old_id", "digest"])
    return batch, held, checked.where("new_id_text = old_id_text").select("digest").distinct()


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, seen (the snapshot holds the text, too) of each row of docs.

    Half of the documents (by a hash of doc_id) are the immutable snapshot, the others the incoming batch. Texts are equal when
    their bytes without white space are; null counts as empty, and empty texts are one group. Of a group, one row stays: that with the most
    code points in its original text, then the smallest doc_id (null first), then any of those that repeat both. Copies of a hot group are
    counted before they are shuffled. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    batch, held, common = dedup_batch(docs.where(~half), docs.where(half))
    common = common.withColumn("seen", F.lit(True))
    rows = batch.withColumn("side", F.lit(1)).unionByName(held.withColumn("side", F.lit(0)))
    # each side's own groups first, then those of digests that both sides hold; the least is the row that stays
    least = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "side", "row")).alias("least")
    own = rows.groupBy("digest", "side").agg(F.count(F.lit(1)).alias("size"), least)
    joined = own.join(common, "digest", "left").withColumn("of", F.when(F.col("seen"), -1).otherwise(F.col("side")))
    groups = joined.groupBy("digest", "of").agg(F.sum("size").alias("group_size"), F.min("least").alias("least"), F.first("seen").alias("seen")).where("group_size > 1")
    groups = table(groups.select("digest", "of", "group_size", F.col("least.doc_id").alias("keep"), F.col("least.side").alias("keep_side"), F.col("least.row").alias("keep_row"), "seen"), "dedup-groups")
    match = (rows["digest"] == groups["digest"]) & ((groups["of"] == -1) | (groups["of"] == rows["side"]))
    alone = F.col("group_size").isNull()
    kept = alone | ((F.col("side") == F.col("keep_side")) & (F.col("row") == F.col("keep_row")))
    return rows.join(groups, match, "left").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), rows["digest"].alias("text_sha256"), F.coalesce("seen", F.lit(False)).alias("seen"))


ORACLE = r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER o = 1 AS kept, h AS text_sha256
FROM n WINDOW o AS (PARTITION BY h ORDER BY c DESC, doc_id NULLS FIRST)
"""
