"""Removal of long repeated strings: merged Burrows-Wheeler transforms of shards of candidate regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keys64, mix64, slices, table, utf8

#: Bytes of a repeated string, and of the grams that place it.
WIDTH, GRAM = 200, 32
#: Bytes of regions of one bucket, of one shard of it; a hash value with more in all is counted by string instead.
BUCKET_BYTES, SHARD_BYTES, HOT_BYTES = 400_000, 100_000, 8 << 20
#: Bytes of a letter of the transforms; a string holds so many whole letters wherever they begin.
LETTER, WHOLE = 8, WIDTH // 8 - 1
#: Rows that a join may broadcast.
FEW_IDS, FEW_SPANS = 500_000, 1_000_000


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the 8 and of the 32 bytes from each place on (8: as many places as bytes; 32: where they fit)."""
    k = keys64(8, 23)
    two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    n = len(eight)
    h = eight * k[0]
    h ^= h >> np.uint64(31)
    sixteen = h[: n - 8] * k[1] + h[8:] * k[2]
    sixteen ^= sixteen >> np.uint64(29)
    whole = sixteen[: n - 24] * k[3] + sixteen[16:] * k[4]
    return h, mix64(whole)


def chosen_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes, the place of the least (by its upper 42 bits), the leftmost of equal ones."""
    n = len(h) - width + 1
    out = np.empty(n, np.int64)
    step = 1 << 20
    low = np.uint64((1 << 22) - 1)
    for a in range(0, n, step):
        m = min(step, n - a)
        part = (h[a : a + m + width - 1] & ~low) | np.arange(m + width - 1, dtype=np.uint64)
        pad = -len(part) % width
        blocks = np.concatenate((part, np.full(pad, ~np.uint64(0)))).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        out[a : a + m] = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & low).astype(np.int64) + a
    return out


def regions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row, the maximal runs of strings of WIDTH bytes that choose the same gram: (row, first string, strings, gram's place in the region, gram's hash, hash of the region).

    Equal strings choose the same gram at the same place, so a string repeats only within the regions of one hash.
    """
    none = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return none, none, none, none, none, none
    eight, whole = gram_hashes(data)
    place = chosen_places(whole, WIDTH - GRAM + 1)
    n = len(place)
    row = np.searchsorted(offsets, np.arange(n), "right") - 1
    valid = np.arange(n) + WIDTH <= offsets[row + 1]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none, none, none
    new = np.append(True, (place[at][1:] != place[at][:-1]) | (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1]))
    first = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    base = int(keys64(1, 29)[0])
    power = np.empty(len(eight) + 1, np.uint64)
    power[0] = 1
    np.cumprod(np.full(len(eight), base, np.uint64), out=power[1:])
    inverse = np.empty(len(eight) + 1, np.uint64)
    inverse[0] = 1
    np.cumprod(np.full(len(eight), pow(base, -1, 1 << 64), np.uint64), out=inverse[1:])
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(eight) * power[:-1])))
    end = first + count - 1 + WIDTH - 7
    own = mix64((total[end] - total[first]) * inverse[first] + count.astype(np.uint64) * keys64(1, 31)[0] + (place[first] - first).astype(np.uint64))
    return row[first], first - offsets[row[first]], count, place[first] - first, whole[place[first]].view(np.int64), own.view(np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of text, in which 0 ends a string and ends sort by place. Ranks of prefixes are doubled until all differ."""
    n = len(text)
    rank = text.astype(np.int64) + n
    rank[text == 0] = np.arange((text == 0).sum())
    key = rank
    step = 1
    while True:
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        step *= 2


def merged_blocks(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge Burrows-Wheeler transforms: the shard of each suffix in merged order, and the number of its block of suffixes with the same `depth` letters.

    Each round, the interleave sorted by h letters becomes the one sorted by h + 1: its suffixes, taken in order, drop stably into the buckets
    of the letters before them. Neighbours stay in one block as long as those letters are equal and their successors were in one block: the
    blocks are the common prefixes. No suffix is compared.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8 if len(transforms) < 256 else np.uint32), [len(b) for b in transforms])
    before = np.concatenate(transforms)
    block = np.zeros(len(shard), np.int32)
    ends = int((before == 0).sum())
    letter = np.empty_like(before)
    for _ in range(depth):
        letter[np.argsort(shard, kind="stable")] = before
        order = np.argsort(letter, kind="stable")
        moved, was, shard = letter[order], block[order], shard[order]
        shard[:ends].sort()  # ends of strings keep the order of shards
        new = np.empty(len(shard), bool)
        new[:1] = False
        new[1:] = (moved[1:] != moved[:-1]) | (was[1:] != was[:-1])
        new[1 : ends + 1] = True
        block = np.cumsum(new, dtype=np.int32)
        if block[-1] == len(block) - 1:
            break
    return shard, block


def prefix_groups(texts: list[np.ndarray], depth: int, shard_letters: int) -> np.ndarray:
    """For each letter of the texts (letters from 1 on), one after another: a number that those share from which the same `depth` letters start, or -1 if no other has them."""
    size = np.array([len(t) + 1 for t in texts])
    first = np.concatenate(([0], np.cumsum(size)))
    shard_of = first[:-1] // max(1, shard_letters)
    cuts = [*np.flatnonzero(np.append(True, shard_of[1:] != shard_of[:-1])).tolist(), len(texts)]
    transforms, orders = [], []
    whole = np.zeros(first[-1], np.uint16 if max((int(t.max()) for t in texts if len(t)), default=0) < 1 << 16 else np.uint32)
    held = np.ones(first[-1], bool)
    held[first[1:] - 1] = False
    whole[held] = np.concatenate(texts)
    for a, b in zip(cuts[:-1], cuts[1:]):
        text = whole[first[a] : first[b]]
        order = suffix_array(text)
        transforms.append(text[order - 1])
        orders.append(order + first[a])
    shard, block = merged_blocks(transforms, depth)
    twin = np.zeros(len(block), bool)
    twin[1:] = block[1:] == block[:-1]
    twin[:-1] |= twin[1:]
    out = np.full(first[-1], -1, np.int64)
    for s, order in enumerate(orders):
        mine = shard == s
        out[order] = np.where(twin[mine], block[mine], -1)
    return out[held]


def repeated_strings(texts: list[bytes], places: list[int], shard_bytes: int = SHARD_BYTES) -> list[list[tuple[int, int]]]:
    """Per region, the runs (first, last) of starts of strings of WIDTH bytes that start elsewhere in the regions, too.

    Equal strings have their gram at the same place, so the regions are read as letters of eight bytes that begin at the gram's place: a
    string holds WHOLE letters and eight more bytes around them. The merge tells which letters begin the same WHOLE letters; strings are equal
    if those and the bytes around them are.
    """
    pad = b"\0" * LETTER
    data = np.frombuffer(pad + b"".join(t + pad for t in texts) + b"\0" * WIDTH, np.uint8)
    word = data[:-7].astype(np.uint64)
    for i in range(1, 8):
        word |= data[i : len(data) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    size = np.array([len(t) for t in texts])
    start = np.concatenate(([0], np.cumsum(size + LETTER)[:-1])) + LETTER
    shift = np.array(places) % LETTER
    letters = np.maximum(0, (size - shift) // LETTER)
    text = np.repeat(np.arange(len(texts)), letters)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(letters) - letters, letters)
    at = start[text] + shift[text] + nth * LETTER
    rank = np.unique(word[at], return_inverse=True)[1] + 1
    group = prefix_groups(np.split(rank, np.cumsum(letters)[:-1]), WHOLE, shard_bytes // LETTER)
    some = group >= 0
    group, text, nth, at = group[some], text[some], nth[some], at[some]
    flags = np.zeros(len(data), bool)
    for k in range(LETTER):  # bytes of a string before its first whole letter
        first = at - k
        inside = (first >= start[text]) & (first + WIDTH <= start[text] + size[text])
        edge = (word[at - LETTER] >> np.uint64(64 - 8 * k) if k else np.uint64(0)) | (word[at + WHOLE * LETTER] & np.uint64((1 << (64 - 8 * k)) - 1)) << np.uint64(8 * k)
        g, e, first = group[inside], np.broadcast_to(edge, at.shape)[inside], first[inside]
        order = np.lexsort((e, g))
        same = (g[order][1:] == g[order][:-1]) & (e[order][1:] == e[order][:-1])
        flags[first[order[1:][same]]] = True
        flags[first[order[:-1][same]]] = True
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    owner = np.searchsorted(start, edges[:, 0], "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for i, (a, b) in zip(owner.tolist(), edges.tolist()):
        out[i].append((a - int(start[i]), b - 1 - int(start[i])))
    return out


def _row_key():
    """A row of documents by 128 bits of its doc_id and text, so that no two of any number of rows meet; rows that repeat share it."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))


def region_table(docs: DataFrame) -> DataFrame:
    """row_key, start, strings, place, gram, region of each region of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                row, start, count, place, gram, own = regions(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(row):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(gram), pa.array(own)], ["row_key", "start", "strings", "place", "gram", "region"])

    return docs.select(_row_key().alias("row_key"), "text").mapInArrow(run, "row_key binary, start int, strings int, place int, gram long, region long")


def region_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, region, place, body of the wanted regions (gram, region, row_key, start, strings, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, places in enumerate(batch.column(1).to_pylist()):
                row = data[offsets[i] : offsets[i + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([p["gram"] for p in places], pa.int64()), pa.array([p["region"] for p in places], pa.int64()), pa.array([p["place"] for p in places], pa.int32()), pa.array([row[p["start"] : p["start"] + p["strings"] + WIDTH - 1] for p in places], pa.binary())], ["gram", "region", "place", "body"])

    places = table(wanted.groupBy("row_key").agg(F.collect_list(F.struct("gram", "region", "start", "strings", "place")).alias("places")), "bwt-places")
    rows = docs.select(_row_key().alias("row_key"), "text")
    if places.count() <= FEW_IDS:  # texts are not moved
        rows = rows.join(F.broadcast(places.select("row_key")), "row_key", "left_semi")
    # of rows that repeat, one is enough
    rows = rows.join(places, "row_key").dropDuplicates(["row_key"])
    return rows.select("text", "places").mapInArrow(run, "gram long, region long, place int, body binary")


def repeated_in_buckets(bodies: DataFrame, buckets: int) -> DataFrame:
    """gram, region, first, last: runs of repeated strings of the regions (gram, region, place, body). A hash value's regions share a bucket."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = repeated_strings(list(part["body"]), part["place"].tolist())
        n = [len(x) for x in found]
        pairs = np.array([p for x in found for p in x], np.int64).reshape(-1, 2)
        return pd.DataFrame({"gram": np.repeat(part["gram"].to_numpy(), n), "region": np.repeat(part["region"].to_numpy(), n), "first": pairs[:, 0], "last": pairs[:, 1]})

    return bodies.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets))).groupBy("bucket").applyInPandas(run, "gram long, region long, first long, last long")


def repeated_by_count(bodies: DataFrame) -> DataFrame:
    """The same for hash values with too many bytes for a bucket: each string is a row, and equal ones are counted."""
    each = bodies.select("gram", "region", F.posexplode(F.expr(f"transform(sequence(1, octet_length(body) - {WIDTH - 1}), i -> sha2(substring(body, i, {WIDTH}), 256))")).alias("first", "string"))
    many = each.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
    return each.join(many, "string", "left_semi").select("gram", "region", F.col("first").cast("long").alias("first"), F.col("first").cast("long").alias("last"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """row_key, spans (array of start and end in bytes, not merged) of each row with strings that start elsewhere, too."""
    all_regions = table(region_table(docs), "bwt-regions")
    one = F.min(F.struct("row_key", "start", "strings", "place")).alias("one")
    kinds = all_regions.groupBy("gram", "region").agg(F.count(F.lit(1)).alias("n"), one)
    kinds = table(kinds.select("gram", "region", "n", "one.row_key", "one.start", "one.strings", "one.place"), "bwt-kinds")
    size = F.col("strings").cast("long") + WIDTH
    mixed = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.sum(size).alias("bytes")).where("k > 1").select("gram", "bytes")
    # regions of one hash that differ: their common strings are found by the merge
    wanted = table(kinds.join(mixed, "gram").select("gram", "region", "row_key", "start", "strings", "place", "n", "bytes"), "bwt-wanted")
    total, hot = wanted.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    found = kinds.where("n > 1").select("gram", "region", F.lit(0).cast("long").alias("first"), (F.col("strings") - 1).cast("long").alias("last"))
    if total:
        bodies = region_texts(docs, wanted)
        buckets = max(1, -(-int(total) // BUCKET_BYTES))
        if hot > HOT_BYTES:
            bodies = table(bodies, "bwt-bodies")
            large = wanted.where(F.col("bytes") > HOT_BYTES).select("gram").distinct()
            some = repeated_in_buckets(bodies.join(large, "gram", "left_anti"), buckets).unionByName(repeated_by_count(bodies.join(large, "gram", "left_semi")))
        else:
            some = repeated_in_buckets(bodies, buckets)
        found = found.unionByName(some.join(wanted.where("n = 1").select("gram", "region"), ["gram", "region"], "left_semi"))
    found = table(found.groupBy("gram", "region").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "bwt-found")
    spans = all_regions.join(found, ["gram", "region"]).select("row_key", "start", F.explode("runs").alias("run"))
    spans = spans.select("row_key", F.struct((F.col("start") + F.col("run.first")).alias("start"), (F.col("start") + F.col("run.last") + WIDTH).alias("end")).alias("span"))
    return spans.groupBy("row_key").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs as start and end in bytes), kept (remaining bytes) of each row of docs.

    Every byte of a string of WIDTH bytes that starts anywhere else, too, is removed; strings are judged on the input, within documents,
    overlaps included. A null text is empty. Rows that repeat are repeats of each other: all of them lose what they share. An empty table
    gives no rows; other columns are ignored. Only regions that share a gram's hash with a different region reach the transforms;
    equal regions are counted at once.
    """
    spans = table(repeated_spans(docs), "bwt-spans")
    rows, n = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    spans = F.broadcast(spans) if rows <= FEW_IDS and n <= FEW_SPANS else spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i in range(0, len(batch), 64):
                sizes, merged, kept = [], [], []
                for j, marks in enumerate(batch.column(2).slice(i, 64).to_pylist(), i):
                    row = data[offsets[j] : offsets[j + 1]]
                    sizes.append(len(row))
                    runs: list[list[int]] = []
                    for a, b in sorted((m["start"], m["end"]) for m in marks or []):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    keep = np.ones(len(row), bool)
                    for a, b in runs:
                        keep[a:b] = False
                    merged.append(runs)
                    kept.append(row[keep].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 64), pa.array(sizes, pa.int64()), pa.array(merged, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = docs.select("doc_id", "text", _row_key().alias("row_key")).join(spans, "row_key", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<array<bigint>>, kept binary")


def repeat_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    rows = remove_repeats(docs)
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


