"""Importance resampling toward a target corpus: hashed n-gram counts as inverted postings, gains by bucket, weights by document."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Scratch, partitions, slices, utf8

#: Feature buckets, and groups of buckets that are scored together. A document has a partial weight per group.
BUCKETS, GROUPS = 10_000, 8
#: Bytes of text in a block of documents; a longer text stands alone and is read in pieces of PIECE bytes.
BLOCK_BYTES, PIECE = 4 << 20, 1 << 20

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = True
_IN_WORD[128:] = True
#: Words up to this length are hashed together, longer ones one by one.
_SHORT = 48


def _crc_table() -> np.ndarray:
    """The 256 steps of CRC-32 for a byte, from its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_STEP = _crc_table()


class _Shift:
    """What a CRC becomes when n bytes follow it: a linear map, as four tables of 256 per length."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def _bits(self, n: int) -> np.ndarray:
        """Images of the 32 single bits after n zero bytes."""
        out, power, left = np.uint32(1) << np.arange(32, dtype=np.uint32), np.uint32(1) << np.arange(32, dtype=np.uint32), n
        power = (power >> np.uint32(8)) ^ _STEP[power & np.uint32(255)]  # one byte
        while left:
            if left & 1:
                out = self._apply(power, out)
            power, left = self._apply(power, power), left >> 1
        return out

    @staticmethod
    def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for b in range(32):
            out ^= np.where(x >> np.uint32(b) & np.uint32(1), matrix[b], np.uint32(0))
        return out

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.empty_like(crc)
        order = np.argsort(lengths, kind="stable")
        kinds, begin = np.unique(lengths[order], return_index=True)
        for n, a, z in zip(kinds.tolist(), begin, np.append(begin[1:], len(order))):
            rows = order[a:z]
            if n > _SHORT:
                out[rows] = self._apply(self._bits(n), crc[rows])
                continue
            if n not in self.tables:
                bits = self._bits(n).reshape(4, 8)
                byte = np.arange(256, dtype=np.uint32)
                self.tables[n] = np.stack([np.bitwise_xor.reduce(np.where(byte[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32(1), b, np.uint32(0)), 1) for b in bits])
            t, x = self.tables[n], crc[rows]
            out[rows] = t[0, x & np.uint32(255)] ^ t[1, x >> np.uint32(8) & np.uint32(255)] ^ t[2, x >> np.uint32(16) & np.uint32(255)] ^ t[3, x >> np.uint32(24)]
        return out


_shift = _Shift()


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of lower-cased bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IN_WORD[data]
    first, last = inside[1:-1] > inside[:-2], inside[1:-1] > inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[1:-1][edges] > 0
    last[edges - 1] = inside[1:-1][edges - 1] > 0
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-length, kind="stable")
    live = np.searchsorted(-length[order], -np.arange(1, _SHORT + 1), "right")  # words that have a j-th byte
    for j, n in enumerate(live.tolist()):
        if not n:
            break
        rows = order[:n]
        crc[rows] = (crc[rows] >> np.uint32(8)) ^ _STEP[(crc[rows] ^ data[start[rows] + j]) & np.uint32(255)]
    crc ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(length > _SHORT).tolist():
        crc[k] = zlib.crc32(data[start[k] : end[k]])
    return crc


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row and bucket of each run of one to three words, words of each row, and where the last word but one begins.

    Not whole: runs that begin at the last two words are left for a later piece, as are these words.
    """
    data = LOWER[data]
    start, end, row = _edges(data, offsets)
    crc, length = _word_crcs(data, start, end), (end - start).astype(np.int64)
    firsts = len(start) if whole else max(0, len(start) - 2)
    rows, found, run = [row[:firsts]], [crc[:firsts]], crc
    for k in (1, 2):
        last = len(start) - k
        if last <= 0:
            break
        space = ~run[:last]
        space = ~((space >> np.uint32(8)) ^ _STEP[(space ^ np.uint32(32)) & np.uint32(255)])
        run = _shift(space, length[k:]) ^ crc[k:]
        use = row[:last] == row[k:]
        use[firsts:] = False
        rows.append(row[:last][use])
        found.append(run[use])
    counts = np.bincount(row[:firsts], minlength=len(offsets) - 1)
    return np.concatenate(rows), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), counts, int(start[-2]) if len(start) > 1 else 0


def _postings(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket * rows + row) ascending with its count, and words and features of each row."""
    rows = len(offsets) - 1
    if rows > 1 or len(data) <= BLOCK_BYTES:
        row, bucket, held, _ = _features(data, offsets, buckets)
        key, count = np.unique(bucket * rows + row, return_counts=True)
        return key, count, held, np.bincount(row, minlength=rows)
    total, held, at = np.zeros(buckets, np.int64), 0, 0
    size = PIECE
    while at < len(data):
        stop = min(len(data), at + size)
        while stop < len(data) and _IN_WORD[LOWER[data[stop]]]:  # not inside a word
            ahead = _IN_WORD[LOWER[data[stop : stop + PIECE]]]
            stop += int(np.argmin(ahead)) if not ahead.all() else len(ahead)
        _, bucket, n, back = _features(data[at:stop], np.array([0, stop - at]), buckets, stop == len(data))
        total += np.bincount(bucket, minlength=buckets)
        held += int(n.sum())
        if stop < len(data) and not n.sum():
            size *= 2  # fewer than three words: a longer piece
            continue
        at, size = (at + back, PIECE) if stop < len(data) else (stop, PIECE)
    key = np.flatnonzero(total)
    return key, total[key], np.array([held]), np.array([total.sum()])


def _pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers as a byte each; those of 255 and more follow as eight bytes each."""
    return np.minimum(values, 255).astype(np.uint8).tobytes(), values[values >= 255].astype(np.int64).tobytes()


def _unpack(short: bytes, long: bytes) -> np.ndarray:
    out = np.frombuffer(short, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(long, np.int64)
    return out


POSTINGS = "block string, grp int, corpus int, doc_ids array<long>, words array<long>, features array<long>, n int, gaps binary, gaps_long binary, counts binary, counts_long binary, sums binary"


def postings(docs: DataFrame, corpus: int, buckets: int = BUCKETS, groups: int = GROUPS) -> DataFrame:
    """POSTINGS of docs (doc_id, text): for a block of n documents, a row per group of buckets, and one (grp -1) with its documents.

    A group's row holds the (bucket, document, count) of its buckets, in that order: gaps between bucket * n + document, and counts; and the sum of each
    bucket. Corpus 1 holds sums alone. Block names are drawn at random, so the rows are to be written before use.
    """
    per = -(-buckets // groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, BLOCK_BYTES):
                n = b - a
                key, count, held, features = _postings(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                name, out = uuid.uuid4().hex, []
                if corpus == 0:
                    out.append((name, -1, corpus, batch.column(0)[a:b].to_pylist(), held.tolist(), features.tolist(), n, None, None, None, None, None))
                cuts = np.searchsorted(key, np.arange(groups + 1) * per * n)
                for g in range(groups):
                    mine, counts = key[cuts[g] : cuts[g + 1]] - g * per * n, count[cuts[g] : cuts[g + 1]]
                    if len(mine):
                        sums = np.bincount(mine // n, weights=counts, minlength=per).astype(np.int64)
                        packed = (*_pack(np.diff(mine, prepend=0)), *_pack(counts)) if corpus == 0 else (None,) * 4
                        out.append((name, g, corpus, None, None, None, n, *packed, sums.tobytes()))
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in out], _SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


_NAMES = [f.split()[0] for f in POSTINGS.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in POSTINGS.split(", ")])


def bucket_sums(held: DataFrame) -> DataFrame:
    """corpus, grp, sums (packed) of all blocks: a row per corpus and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for corpus, grp, sums in zip(*(c.to_pylist() for c in batch.columns)):
                more = np.frombuffer(sums, np.int64)
                total[corpus, grp] = total[corpus, grp] + more if (corpus, grp) in total else more
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], ["corpus", "grp", "sums"])

    schema = "corpus int, grp int, sums binary"
    parts = held.where("sums IS NOT NULL").select("corpus", "grp", "sums").mapInArrow(run, schema)  # a row per task, corpus and group
    return parts.repartition("corpus", "grp").mapInArrow(run, schema)


def gain(s: int, t: int, of: int, target: int, buckets: int = BUCKETS) -> int:
    """What a feature of a bucket adds: log of the smoothed ratio of its shares in the target (t of target) and in all documents (s of of), in thousandths."""
    return math.floor(1000 * math.log((float(t + 1) * float(of + buckets)) / (float(s + 1) * float(target + buckets))))


def contributions(held: DataFrame, sums: DataFrame, buckets: int = BUCKETS, groups: int = GROUPS, salts: int = 1) -> DataFrame:
    """block, weights (packed): what each group of buckets adds to each document of a block.

    Postings are shuffled to their group, dealt over `salts` parts by block. The sums of both corpora go to each part of their group, ahead of
    the postings, so that gains are computed where the postings are.
    """
    per = -(-buckets // groups)
    totals = {r.corpus: r.total for r in sums.select("corpus", F.expr("sums")).mapInArrow(_totals, "corpus int, total long").groupBy("corpus").agg(F.sum("total").alias("total")).collect()}
    of, target = totals.get(0, 0), totals.get(1, 0)
    columns = ["grp", "salt", "first", "corpus", "block", "n", "gaps", "gaps_long", "counts", "counts_long", "sums"]
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    rows = held.where("corpus = 0 AND grp >= 0").select("grp", salt.alias("salt"), F.lit(1).alias("first"), "corpus", "block", "n", "gaps", "gaps_long", "counts", "counts_long", F.lit(None).cast("binary").alias("sums"))
    ahead = sums.select("grp", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("first"), "corpus", F.lit("").alias("block"), F.lit(0).alias("n"), *[F.lit(None).cast("binary").alias(c) for c in columns[6:10]], "sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, both, gains = None, {}, None
        for batch in batches:
            blocks, packed = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                grp, part, first, corpus, block, n, gaps, gaps_long, counts, counts_long, held_sums = row
                if (grp, part) != now:
                    now, both, gains = (grp, part), {}, None
                if first == 0:
                    both[corpus] = np.frombuffer(held_sums, np.int64)
                    continue
                if gains is None:
                    s, t = (both.get(c, np.zeros(per, np.int64)).tolist() for c in (0, 1))
                    gains = np.array([gain(x, y, of, target, buckets) for x, y in zip(s, t)], np.int64)
                key = np.cumsum(_unpack(gaps, gaps_long))
                value = gains[key // n] * _unpack(counts, counts_long)
                row_of = key % n
                order = np.argsort(row_of, kind="stable")
                edges = np.searchsorted(row_of[order], np.arange(n + 1))
                running = np.concatenate(([0], np.cumsum(value[order])))
                blocks.append(block)
                packed.append((running[edges[1:]] - running[edges[:-1]]).tobytes())
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(packed, pa.binary())], ["block", "weights"])

    dealt = rows.unionByName(ahead).repartitionById(groups * salts, F.col("grp") * salts + F.col("salt")).sortWithinPartitions("grp", "salt", "first")
    return dealt.select(*columns).mapInArrow(run, "block string, weights binary")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(np.frombuffer(x, np.int64).sum()) for x in batch.column(1).to_pylist()], pa.int64())], ["corpus", "total"])


def document_weights(docs: DataFrame, target: DataFrame, scratch: Scratch, buckets: int = BUCKETS, groups: int = GROUPS) -> DataFrame:
    """doc_id, words, n_features, weight of each row of docs (doc_id, text); target: the texts (text) to be like."""
    spark = docs.sparkSession
    asked = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    held = scratch.table(postings(docs, 0, buckets, groups).unionByName(postings(asked, 1, buckets, groups)), "postings")
    sums = scratch.table(bucket_sums(held), "sums")
    added = contributions(held, sums, buckets, groups, -(-partitions(spark) // groups))
    blocks = held.where("grp = -1").select("block", "doc_ids", "words", "features", F.lit(None).cast("binary").alias("weights"))
    added = added.select("block", *[F.lit(None).cast("array<long>").alias(c) for c in ("doc_ids", "words", "features")], "weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, columns, total = None, None, None
        for batch in batches:
            lists = [batch.column(c) for c in (1, 2, 3)]
            for k, (block, weights) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist())):
                if block != name:
                    if name is not None:
                        yield done(columns, total)
                    name, total = block, 0
                if weights is None:  # sorts first
                    columns = [c[k].values for c in lists]
                else:
                    total = total + np.frombuffer(weights, np.int64)
        if name is not None:
            yield done(columns, total)

    def done(columns: list[pa.Array], total: np.ndarray | int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(len(columns[0]), np.int64) + total)], ["doc_id", "words", "n_features", "weight"])

    met = blocks.unionByName(added).repartition("block").sortWithinPartitions("block", F.col("weights").isNotNull())
    return met.mapInArrow(run, "doc_id long, words long, n_features long, weight long")


def draw_noise(doc_id: Column, seed: int = 42) -> Column:
    """A Gumbel deviate of a document, in thousandths: the largest sums of weight and noise are a draw without replacement by weight."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, most: int, order: list[Column], score: str, parts: int) -> DataFrame:
    """rows with rank: 1, 2, ... of the first `most` by `score` descending and then `order`, null beyond.

    Quantiles of the score cut the rows into ranges; a count of each range, one row per range on the driver, gives the rank at which it begins; windows
    order the ranges that hold a rank to give. Rows that are equal in all columns are counted and ordered as one.
    """
    columns = rows.columns
    marks = rows.select(F.percentile_approx(score, [k / parts for k in range(1, parts)], 10_000)).first()[0] if most and parts > 1 else None
    marks = sorted(set(marks or []))
    # the number of marks below a score: ranges are numbered from the lowest scores
    of = F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m < F.col(score))) if marks else F.lit(0)
    rows = rows.withColumn("range", of)
    begins, seen = {}, 0
    for r in sorted(rows.groupBy("range").count().collect(), key=lambda r: -r["range"]):
        if seen < most:
            begins[r["range"]] = seen
        seen += r["count"]
    lowest = min(begins, default=len(marks) + 1)
    near = rows.where(F.col("range") >= lowest).groupBy(*columns, "range").agg(F.count(F.lit(1)).alias("copies"))
    before = Window.partitionBy("range").orderBy(F.col(score).desc(), *order, *columns).rowsBetween(Window.unboundedPreceding, -1)
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for k, v in begins.items() for x in (k, v)]), F.col("range").cast("long")) if begins else F.lit(0).cast("long")
    near = near.withColumn("start", start + F.coalesce(F.sum("copies").over(before), F.lit(0)))
    near = near.select(*columns, F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("copies"))).alias("at"))
    near = near.select(*columns, F.when(F.col("at") <= most, F.col("at")).alias("rank"))
    return near.unionByName(rows.where(F.col("range") < lowest).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, groups: int = GROUPS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs: importance resampling toward the texts of target.

    Words are runs of a-z (A-Z made lower), 0-9 and all letters beyond ASCII; features are all runs of one to three words, hashed into buckets.
    A document's weight is the sum of its features' gains; its score adds Gumbel noise that its doc_id alone decides. Of the documents with at
    least `least_words` words, `percent` of a hundred (rounded down) are drawn by score, ties by doc_id, null last; rank numbers them. A null or empty text has no features and
    weight 0; rows that repeat are documents of their own, of equal score; an empty table gives no rows, an empty target leaves only the
    smoothing; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    rows = document_weights(docs.select("doc_id", "text"), target.select("text"), scratch, buckets, groups)
    scores = scratch.table(rows.withColumn("score", F.col("weight") + draw_noise(F.col("doc_id"), seed)), "scores")
    able = scores.where(F.col("words") >= least_words).drop("words")
    drawn = ranked(able, able.count() * percent // 100, [F.col("doc_id").asc_nulls_last()], "score", 4 * partitions(docs.sparkSession))
    return drawn.unionByName(scores.where(F.col("words") < least_words).drop("words").withColumn("rank", F.lit(None).cast("long")))


#: DuckDB SQL of the query's rows: CRC-32 by steps of a table made from its polynomial.
ORACLE = r"""
WITH steps AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b))),
texts AS (SELECT 0 AS corpus, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, NULL, coalesce(text, '') FROM benchmark),
said AS (SELECT row_number() OVER () AS n, corpus, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT n, corpus, w, unnest(range(1, len(w) + 1)) AS i FROM said),
features AS (SELECT n, corpus, unnest(list_filter([w[i], CASE WHEN i + 1 <= len(w) THEN w[i] || ' ' || w[i + 1] END, CASE WHEN i + 2 <= len(w) THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END], lambda f: f IS NOT NULL)) AS f FROM runs),
counted AS (SELECT n, corpus, f, count(*) AS k FROM features GROUP BY ALL),
hashed AS (SELECT f, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(f), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), steps),
held AS (SELECT n, corpus, bucket, sum(k) AS k FROM counted JOIN hashed USING (f) GROUP BY ALL),
totals AS (SELECT coalesce(sum(k) FILTER (corpus = 0), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (corpus = 1), 0)::DOUBLE AS t FROM held),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(sum(k) FILTER (corpus = 1), 0) + 1)::DOUBLE * (any_value(totals.s) + 10000)) / ((coalesce(sum(k) FILTER (corpus = 0), 0) + 1)::DOUBLE * (any_value(totals.t) + 10000))))::BIGINT AS gain FROM held, totals GROUP BY bucket),
weights AS (SELECT n, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM held JOIN gains USING (bucket) WHERE corpus = 0 GROUP BY n),
scored AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM said LEFT JOIN weights USING (n) WHERE corpus = 0),
drawn AS (SELECT *, words >= 20 AS able, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= 20) AS held FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * held // 100 THEN place END AS rank FROM drawn
"""
