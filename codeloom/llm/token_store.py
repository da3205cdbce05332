"""Token files: raw id payloads with a minimal perfect hash from document keys to offsets."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, mix64, shared_dir, tidy, utf8

#: Bytes of ids after which a block of the file ends, and documents that it holds at most.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 1 << 14
#: Rows of documents per shard of the file.
SHARD_ROWS = 100_000
#: Encoded words that a worker remembers.
REMEMBERED = 500_000
_NO_ID = -(1 << 63)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit arrays per level hold the keys that stand alone there; a key's number is its bit's rank."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        self.flags = np.unpackbits(bits, bitorder="little")
        #: ones before each group of 512 bits
        padded = np.concatenate((self.flags, np.zeros(-len(self.flags) % 512, np.uint8))).reshape(-1, 512)
        self.ranks = np.concatenate(([0], np.cumsum(padded.sum(1, dtype=np.int64))))
        self.inner = (np.cumsum(padded, 1, dtype=np.int16) - padded).ravel()

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, bits = keys, [], []
        while len(left):
            size = 2 * len(left) + 1
            at = cls._at(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
            if len(sizes) > 200:
                raise ValueError("keys repeat")
        flags = np.concatenate(bits) if bits else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flags, bitorder="little"))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1 or any number for a key that was not built in, which the fingerprint then tells."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts)):
            if not len(left):
                break
            at = self._at(keys[left], level, int(size)) + start
            hit = self.flags[at] == 1
            out[left[hit]] = self.ranks[at[hit] >> 9] + self.inner[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], np.int64).tobytes() + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        return cls(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint8, offset=8 + 8 * n))


def key64(doc_id: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The key of the nth row with that doc_id."""
    return mix64(mix64(doc_id.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(40)).astype(np.uint32)


#: Where a text may be cut without a change of its ids: white space always ends a piece of the word pattern.
_PIECES = re.compile(r"[^ \t-\r]+")
#: Pieces of printable ASCII but capitals and the apostrophe, and of small Latin-1 letters, and the pattern's parts of such a piece.
_SIMPLE = re.compile(r"[!-&(-@\[-~ß-öø-ÿ]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Spaces of Python's split() that the pattern may not take for such.
_ODD = "\x1c\x1d\x1e\x1f\x85\xa0"


class Remembered:
    """A bounded dictionary: what was used since the last two turns is kept."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys) -> list:
        """The keys that are not held; the others are in new after that."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        absent = [k for k in keys if k not in new]
        for k in absent:
            if k in old:
                new[k] = old[k]
        return [k for k in absent if k not in new]


class Encoder:
    """Ids of texts by the tokenizers library, which sees each distinct part of a word pattern once while it is remembered."""

    def __init__(self, config: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.pieces, self.parts = Remembered(REMEMBERED), Remembered(REMEMBERED)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: ids that end a part
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, config: str) -> Encoder:
        key = zlib.crc32(config.encode())
        encoders = held("token_store")
        if key not in encoders:
            encoders[key] = cls(config)
        return encoders[key]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def split(text: str) -> list[str]:
        """Pieces between white space, in lower case where that cannot differ from the tokenizer's."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _PIECES.findall(text)
        if any(c in text for c in _ODD):
            return _PIECES.findall(text)
        return text.lower().split()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Raw ids of each text."""
        split = [self.split(t) for t in texts]
        absent = self.pieces.missing({p for pieces in split for p in pieces})
        known = self.pieces.new
        simple = {p: _PARTS.findall(p) for p in absent if _SIMPLE.fullmatch(p) and not any(t in p for t in self.added)}
        new = self.parts.missing({x for parts in simple.values() for x in parts})
        held = self.parts.new
        for i in range(0, len(new), 1024):
            # each part is one word of the pattern, and ends with the only id that ends a word
            part = new[i : i + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                held.update(zip(part, self.whole(part)))
                continue
            for x, a, z in zip(part, [0, *ends[:-1].tolist()], ends.tolist()):
                held[x] = ids[a:z].tobytes()
        for p, parts in simple.items():
            known[p] = held[p] if len(parts) == 1 else b"".join([held[x] for x in parts])
        rest = [p for p in absent if p not in simple]
        for i in range(0, len(rest), 4096):
            known.update(zip(rest[i : i + 4096], self.whole(rest[i : i + 4096])))
        get = known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


#: The normaliser and word pattern that the pieces and parts above are made for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_at_space(config: str) -> bool:
    """Whether pieces between white space can be encoded alone: for the one normaliser and word pattern that this is known of. Others encode whole texts."""
    said = json.loads(config)
    model, added = said.get("model") or {}, said.get("added_tokens") or []
    plain = said.get("normalizer") == _NORMALIZER and said.get("pre_tokenizer") == _PRE_TOKENIZER
    plain = plain and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("continuing_subword_prefix")
    return plain and not said.get("truncation") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in added)


def write_tokens(docs: DataFrame, config: str, path: str, end_id: int = 1, shard_rows: int = SHARD_ROWS) -> None:
    """Encode every text of docs and write the token file: Parquet folders of blocks in ascending doc_id order, of an index, and of its size.

    Columns of a block: shard (its folder), block, n_docs, n_tokens, first_key and last_key (doc_id), keys (doc_id and number of the row
    among those with that doc_id), hash (PerfectHash of the keys), prints and places (by hash number: 24 bits of fingerprint, and offset
    and length in ids), width (bytes of an id), payload (raw little-endian ids). Columns of the index: bucket of keys (its folder), hash,
    prints and places (shard and block). So a key's hash names its row of the index, and that its block: two rows are read, however many there are.
    A null text is encoded as empty, a null doc_id sorts first, rows that repeat a doc_id stand in the order of a hash of their texts, then
    of their ids' bytes, and may fill several shards; only rows equal in both share one. end_id follows each document. An empty table
    gives empty folders.
    """
    spark = docs.sparkSession
    whole = not splits_at_space(config)
    n = docs.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if n > 1000 else 1, -(-n // shard_rows))
    marks = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("k")).approxQuantile("k", [i / shards for i in range(1, shards)], 0.1 / shards) if shards > 1 and n else []
    bounds = np.sort(np.array(marks, np.float64).astype(np.int64))
    shards = len(bounds) + 1
    earlier = _rows_before(docs, bounds)
    sent = spark.sparkContext.broadcast(config)  # one tokenizer file, of fixed size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(sent.value)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            keys = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            sizes = utf8(batch.column(1))[1]
            first = 0
            while first < len(keys):
                last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + (2 << 20), "right")) - 1)
                texts = [x or "" for x in batch.column(1).slice(first, last - first).to_pylist()]
                ids = [x + end for x in (encoder.whole(texts) if whole else encoder.ids(texts))]
                tie = batch.column(2).slice(first, last - first)
                shard = _shards(bounds, keys[first:last], tie.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(keys[first:last]), tie, pa.array(ids, pa.binary())], ["shard", "doc_id", "tie", "ids"])
                first = last

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(Encoder.of(sent.value).kind).itemsize
        block = shard = nth = 0
        keys, order, parts, held, previous = [], [], [], 0, None

        def done() -> pa.RecordBatch:
            key, number = np.array(keys, np.int64), np.array(order, np.int64)
            lengths = np.array([len(p) // width for p in parts], np.int64)
            hashed = key64(key, number)
            f = PerfectHash.build(hashed)
            slot = f.numbers(hashed)
            prints, places = np.zeros(len(key), np.uint32), np.zeros((len(key), 2), np.uint32)
            prints[slot] = fingerprint(hashed)
            places[slot, 0], places[slot, 1] = np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths
            row = [block, len(key), int(lengths.sum()), int(key[0]), int(key[-1]), np.stack([key, number], 1).tobytes(), f.to_bytes(), prints.tobytes(), places.tobytes(), width, b"".join(parts), shard]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, _FILE)], [c for c, _ in _FILE])

        for batch in batches:
            for s, k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if keys and (s != shard or held + len(ids) > BLOCK_BYTES or len(keys) >= BLOCK_DOCS):
                    yield done()
                    block, keys, order, parts, held = (block + 1 if s == shard else 0), [], [], [], 0
                nth = nth + 1 if previous == (s, k) else earlier.get((s, k), 0)
                previous, shard = (s, k), s
                keys.append(k)
                order.append(nth)
                parts.append(ids)
                held += len(ids)
        if keys:
            yield done()

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), _tie().alias("tie")).mapInArrow(tidy("token_store", encode), "shard int, doc_id long, tie long, ids binary")
    dealt = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie", "ids")
    dealt.mapInArrow(tidy("token_store", pack), FILE_SCHEMA).write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/blocks")
    _write_index(spark, path, shards)


def _tie():
    """What orders rows of one doc_id: a hash of the text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _parts(tie: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of `many` parts a row falls in; parts ascend with tie."""
    return ((tie >> 32) + (1 << 31)) * many >> 32


def _shards(bounds: np.ndarray, keys: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The shard of each row. A doc_id that is several bounds has rows for as many shards, and fills them by tie."""
    first = np.searchsorted(bounds, keys, "left")
    many = np.maximum(1, np.searchsorted(bounds, keys, "right") - first)
    return (first + _parts(tie, many)).astype(np.int32)


def _rows_before(docs: DataFrame, bounds: np.ndarray) -> dict[tuple[int, int], int]:
    """(shard, doc_id): rows of that doc_id in earlier shards, for those that fill several. There are no more than shards."""
    hot, first, many = np.unique(bounds, return_index=True, return_counts=True)
    some = many > 1
    if not some.any():
        return {}
    wide = docs.sparkSession.createDataFrame(list(zip(hot[some].tolist(), first[some].tolist(), many[some].tolist())), "k long, first long, many long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k"), _tie().alias("tie"))
    part = F.shiftright((F.shiftright("tie", 32) + F.lit(1 << 31)) * F.col("many"), 32)
    held = rows.join(F.broadcast(wide), "k").groupBy("k", (F.col("first") + part).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    out, run, last = {}, 0, None
    for k, shard, n in sorted(map(tuple, held.collect())):
        run = run if k == last else 0
        out[shard, k] = run
        run, last = run + n, k
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(buckets)).astype(np.int32)


def _write_index(spark: SparkSession, path: str, buckets: int) -> None:
    """The index of the blocks in path: a row per bucket of keys. Its size is written last, so a file without it is not whole."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = np.frombuffer(row["keys"], np.int64).reshape(-1, 2)
                keys = key64(pairs[:, 0], pairs[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(keys, buckets)), pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), row["shard"], np.int32)), pa.array(np.full(len(keys), row["block"], np.int32))], ["bucket", "key", "shard", "block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        every = pa.Table.from_batches(held)
        bucket, keys, shard, block = (every[c].to_numpy() for c in ("bucket", "key", "shard", "block"))
        for one in np.unique(bucket):
            mine = bucket == one
            hashed = keys[mine].view(np.uint64)
            f = PerfectHash.build(hashed)
            slot = f.numbers(hashed)
            prints, places = np.zeros(len(slot), np.uint32), np.zeros((len(slot), 2), np.uint32)
            prints[slot] = fingerprint(hashed)
            places[slot, 0], places[slot, 1] = shard[mine], block[mine]
            row = [len(slot), f.to_bytes(), prints.tobytes(), places.tobytes(), int(one)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, _INDEX)], [c for c, _ in _INDEX])

    blocks = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks").select("shard", "block", "keys")
    keys = blocks.mapInArrow(tidy("token_store", keyed), "bucket int, key long, shard int, block int").repartitionById(buckets, F.col("bucket"))
    keys.mapInArrow(tidy("token_store", pack), INDEX_SCHEMA).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/index")
    spark.range(0, 1, 1, 1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/size")


_FILE = [("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("keys", pa.binary()), ("hash", pa.binary()), ("prints", pa.binary()), ("places", pa.binary()), ("width", pa.int32()), ("payload", pa.binary()), ("shard", pa.int32())]
FILE_SCHEMA = "block int, n_docs long, n_tokens long, first_key long, last_key long, keys binary, hash binary, prints binary, places binary, width int, payload binary, shard int"
_INDEX = [("n_keys", pa.int64()), ("hash", pa.binary()), ("prints", pa.binary()), ("places", pa.binary()), ("bucket", pa.int32())]
INDEX_SCHEMA = "n_keys long, hash binary, prints binary, places binary, bucket int"


def look_up(hash_: bytes, prints: bytes, places: bytes, keys: np.ndarray) -> np.ndarray:
    """The place of each key of a block (offset and length in ids) or of the index (shard and block); -1 where the fingerprint says that it is not there."""
    out = np.full((len(keys), 2), -1, np.int64)
    slot = PerfectHash.from_bytes(hash_).numbers(keys)
    good = slot >= 0
    good[good] = np.frombuffer(prints, np.uint32)[slot[good]] == fingerprint(keys[good])
    out[good] = np.frombuffer(places, np.uint32).reshape(-1, 2)[slot[good]]
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The file's documents: shard, block, doc_id, nth (row of that doc_id), offset (in its block), n_tokens, ids (raw, 4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], np.int64).reshape(-1, 2)
                at = look_up(row["hash"], row["prints"], row["places"], key64(keys[:, 0], keys[:, 1]))
                ids = np.frombuffer(row["payload"], np.uint16 if row["width"] == 2 else np.uint32)
                for a in range(0, len(keys), 1024):
                    here = at[a : a + 1024]
                    missing = keys[a : a + 1024, 0] == _NO_ID
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(here), row["shard"], np.int32)), pa.array(np.full(len(here), row["block"], np.int32)),
                        pa.array(keys[a : a + 1024, 0], mask=missing), pa.array(keys[a : a + 1024, 1]), pa.array(here[:, 0]), pa.array(here[:, 1]),
                        pa.array([ids[o : o + n].astype("<u4").tobytes() for o, n in here], pa.binary()),
                    ], ["shard", "block", "doc_id", "nth", "offset", "n_tokens", "ids"])

    files = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks").select("shard", "block", "keys", "hash", "prints", "places", "width", "payload")
    return files.mapInArrow(tidy("token_store", run), "shard int, block int, doc_id long, nth long, offset long, n_tokens long, ids binary")


def token_ids(spark: SparkSession, path: str, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
    """Keyed access: the ids of the nth row with that doc_id, or None. One row of the index gives its block, and one block its ids."""
    key = key64(np.array([_NO_ID if doc_id is None else doc_id], np.int64), np.array([nth]))
    buckets = spark.read.schema("buckets int").parquet(f"{path}/size").first()["buckets"]
    index = spark.read.schema(INDEX_SCHEMA).option("basePath", f"{path}/index")
    try:
        row = index.parquet(f"{path}/index/bucket={_bucket(key, buckets)[0]}").first()
    except AnalysisException as e:  # no key has that bucket
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    shard, block = look_up(row["hash"], row["prints"], row["places"], key)[0].tolist()
    if shard < 0:
        return None
    blocks = spark.read.schema(FILE_SCHEMA).option("basePath", f"{path}/blocks").parquet(f"{path}/blocks/shard={shard}")
    row = blocks.where(F.col("block") == block).first()
    offset, n = look_up(row["hash"], row["prints"], row["places"], key)[0]
    return None if offset < 0 else np.frombuffer(row["payload"], np.uint16 if row["width"] == 2 else np.uint32)[offset : offset + n].astype(np.uint32)


def document_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, block_start: ids of all blocks before, by sums per shard and then within each shard."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks").select("shard", "block", "n_tokens")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard meets in one window
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("held")).withColumn("shard_start", F.coalesce(F.sum("held").over(before(Window.partitionBy(F.lit(0)).orderBy("shard"))), F.lit(0)))
    inner = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("shard").orderBy("block"))), F.lit(0))
    return blocks.withColumn("inner", inner).join(shards.select("shard", "shard_start"), "shard").select("shard", "block", (F.col("shard_start") + F.col("inner")).alias("block_start"))


def token_digest(docs: DataFrame, config: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each row of docs, from a token file written and read back.

    Whole texts are encoded, however long; a null or empty text has the end id alone. A null doc_id comes first; rows that repeat a doc_id
    stand in the order of a hash of their texts, then of their ids' bytes. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, config, path, end_id)
    rows = read_tokens(spark, path).select("shard", "block", "doc_id", "offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(document_starts(spark, path), ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
