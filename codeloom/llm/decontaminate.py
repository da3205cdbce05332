"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix64, plain_names, slices, tidy, utf8

#: Bytes of a q-gram.
Q = 12
#: Bytes of item texts that one pass over the documents holds; larger benchmarks take more passes.
PASS_BYTES = 4 << 20
_FILTER_BITS = 22
#: Postings that are counted at once; bands in a row that are aligned at once, from so many on; room for bands before a text's begin.
POSTINGS, MERGED, MANY, _BELOW = 1 << 21, 1 << 15, 4, 1 << 20

#: Letters of A-Z in lower case; ASCII punctuation and controls as space; other bytes as they are.
PLAIN = LOWER.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes with single spaces, the rows' offsets in them, and each byte's place in data."""
    t = PLAIN[data]
    keep = t != 32
    inner = np.ones(len(t), bool)
    inner[1:] = keep[:-1]
    edges = offsets[1:-1]
    inner[edges[edges < len(t)]] = False
    inner[:1] = False
    keep |= inner
    place = np.flatnonzero(keep)
    return t[place], np.concatenate(([0], np.cumsum(keep)))[offsets], place


def grams(t: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each place on."""
    if len(t) < Q:
        return np.zeros(0, np.uint64)
    two = t[:-1].astype(np.uint64) | t[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    n = len(t) - Q + 1
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ four[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(29)


@dataclass(frozen=True)
class Bounds:
    """Characters of a segment of an item; between segments; and per edit that a segment may have."""

    segment: int = 80
    stride: int = 20
    per_edit: int = 20


@dataclass
class Index:
    """q-grams of the segments of some items, and the items that are shorter than one."""

    ids: list  # by item
    short: dict  # by number of words: texts of short items, and their items
    items: list  # by segment
    texts: list[bytes]  # by segment
    copies: list[int]  # by segment: how often its item has it
    edits: np.ndarray
    least: np.ndarray  # q-grams that a match shares at least
    grams: np.ndarray  # sorted, distinct
    first: np.ndarray  # of the postings of each
    segment: np.ndarray
    place: np.ndarray
    screen: np.ndarray

    @classmethod
    def of(cls, items: list[tuple], bounds: Bounds) -> Index:
        names, texts, copies, short = [], [], [], {}
        for item, (_, text) in enumerate(items):
            t = plain(*utf8(pa.array([text or ""])))[0].tobytes().strip()
            if 0 < len(t) < Q:
                short.setdefault(t.count(b" ") + 1, {}).setdefault(t, []).append(item)
            if len(t) < Q:
                continue
            starts = list(range(0, max(1, len(t) - bounds.segment + 1), bounds.stride))
            if len(t) > bounds.segment:
                starts.append(len(t) - bounds.segment)
            # equal segments of an item are one
            for part, n in Counter(t[s : s + bounds.segment] for s in dict.fromkeys(starts)).items():
                names.append(item)
                texts.append(part)
                copies.append(n)
        size = np.array([len(t) for t in texts], np.int64)
        edits = np.minimum(size // bounds.per_edit, (size - Q) // Q)
        all_grams = [grams(np.frombuffer(t, np.uint8)) for t in texts]
        gram = np.concatenate([*all_grams, np.zeros(0, np.uint64)])
        segment = np.repeat(np.arange(len(texts)), [len(g) for g in all_grams]).astype(np.int64)
        place = np.concatenate([*(np.arange(len(g)) for g in all_grams), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(gram, kind="stable")
        unique, first = np.unique(gram[order], return_index=True)
        screen = np.zeros(1 << _FILTER_BITS, bool)
        screen[(mix64(unique) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls([i for i, _ in items], short, names, texts, copies, edits, size - Q + 1 - edits * Q, unique, np.append(first, len(gram)), segment[order], place[order], screen)


def _last_row(pattern: bytes, text: np.ndarray, shift: int, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By diagonal shift .. shift + band: least edits that turn pattern into a part of text that ends there, where that part starts, and the diagonal."""
    p, t = np.frombuffer(pattern, np.uint8), text
    far = len(p) + 1
    diagonals = np.arange(shift, shift + band + 1)
    cost = np.where((diagonals >= 0) & (diagonals <= len(t)), 0, far)
    start = diagonals.copy()
    step = np.arange(len(diagonals))
    for i in range(1, len(p) + 1):
        j = i + diagonals  # cell (i, j)
        inside = (j >= 1) & (j <= len(t))
        same = np.where(inside, t[np.clip(j - 1, 0, max(0, len(t) - 1))] != p[i - 1], far)
        down, down_start = np.append(cost[1:] + 1, far), np.append(start[1:], 0)
        across = cost + same
        best = np.minimum(across, down)
        first = np.where(across <= down, start, down_start)
        # runs of insertions along the row
        level = np.minimum.accumulate(best - step)
        source = np.maximum.accumulate(np.where(best - step == level, step, 0))
        cost, start = np.where((j >= 0) & (j <= len(t)), level + step, far), first[source]
    return cost, start, diagonals


def aligned(pattern: bytes, text: bytes, shift: int, band: int) -> tuple[int, int, int]:
    """Least edits that turn pattern into a part of text, and that part's start and end, on diagonals shift .. shift + band."""
    cost, start, diagonals = _last_row(pattern, np.frombuffer(text, np.uint8), shift, band)
    at = int(np.argmin(cost))
    return int(cost[at]), int(start[at]), int(len(pattern) + diagonals[at])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(key)).astype(np.int64)


def find(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, segment, start, end, edits) of each segment that a row holds within its edit budget; start and end in bytes of the row.

    Where bands of a segment follow one another, as in periodic texts, they are aligned at once and give one row: around all that is found, with the least edits.
    """
    t, at, origin = plain(data, offsets)
    gram = grams(t)
    if not len(gram) or not len(index.grams):
        return []
    hit = np.flatnonzero(index.screen[((mix64(gram)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    slot = np.searchsorted(index.grams, gram[hit])
    good = slot < len(index.grams)
    good[good] = index.grams[slot[good]] == gram[hit[good]]
    hit, slot = hit[good], slot[good]
    row = np.searchsorted(at, hit, "right") - 1
    whole = hit + Q <= at[row + 1]
    hit, slot, row = hit[whole], slot[whole], row[whole]
    if not len(hit):
        return []
    held = index.first[slot + 1] - index.first[slot]
    # so many postings at once, whatever a text repeats
    cuts = np.unique(np.append(np.searchsorted(np.cumsum(held), np.arange(0, held.sum(), POSTINGS), "left"), len(hit)))
    n = len(index.texts)

    def postings() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, z in zip(cuts[:-1], cuts[1:]):
            many = held[a:z]
            post = np.repeat(index.first[slot[a:z]] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            segment = index.segment[post]
            yield np.repeat(row[a:z], many) * n + segment, segment, np.repeat(hit[a:z] - at[row[a:z]], many) - index.place[post]

    # enough q-grams of a segment in a row at all
    pairs, count = _summed([np.unique(pair, return_counts=True) for pair, _, _ in postings()])
    pairs = pairs[count >= index.least[pairs % n]]
    if not len(pairs):
        return []
    # enough of them in one of the bands, each of which overlaps the next by half
    parts = []
    for pair, segment, diagonal in postings():
        number = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        good = pairs[number] == pair
        band = diagonal[good] // (index.edits[segment[good]] + 1) + _BELOW
        key = number[good] << 32 | band
        parts.append(np.unique(np.concatenate((key, key - 1)), return_counts=True))
    key, count = _summed(parts)
    key = key[count >= index.least[pairs[key >> 32] % n]]
    out = []
    for a, z in zip(*(lambda e: (np.append(0, e), np.append(e, len(key))))(np.flatnonzero(np.diff(key) != 1) + 1)):
        if a == z:
            continue
        r, s = divmod(int(pairs[key[a] >> 32]), n)
        k, pattern = int(index.edits[s]), index.texts[s]
        bands = (key[a:z] & 0xFFFFFFFF) - _BELOW
        text = t[at[r] : at[r + 1]]
        if z - a >= MANY:
            for i in range(0, z - a, MERGED):
                found = _aligned_run(pattern, text, int(bands[i]), len(bands[i : i + MERGED]), k)
                if found is not None:
                    out.append((r, s, int(origin[at[r] + found[0]] - offsets[r]), int(origin[at[r] + found[1] - 1] + 1 - offsets[r]), found[2]))
            continue
        for b in bands.tolist():
            low = b * (k + 1)
            first = max(0, low - k)
            region = text[first : low + 2 * (k + 1) + len(pattern) + k].tobytes()
            found = region.find(pattern)
            edits, x, y = (0, found, found + len(pattern)) if found >= 0 else aligned(pattern, region, low - k - first, 2 * (k + 1) + 2 * k)
            if edits <= k and y > x:
                out.append((r, s, int(origin[at[r] + first + x] - offsets[r]), int(origin[at[r] + first + y - 1] + 1 - offsets[r]), edits))
    return out


def _aligned_run(pattern: bytes, text: np.ndarray, band: int, bands: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, least edits) around the best part of each of some bands in a row that is within k edits; none if no band has one."""
    low = band * (k + 1) - k
    width = 4 * k + 3  # diagonals of a band with what k edits may leave it by
    cost, start, diagonals = _last_row(pattern, text, low, (bands - 1) * (k + 1) + width - 1)
    each = np.lib.stride_tricks.sliding_window_view(cost, width)[:: k + 1]
    best = each.argmin(1) + np.arange(len(each)) * (k + 1)
    best = best[cost[best] <= k]
    best = best[len(pattern) + diagonals[best] > start[best]]
    if not len(best):
        return None
    return int(start[best].min()), int((len(pattern) + diagonals[best]).max()), int(cost[best].min())


def find_short(index: Index, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, start, end) of each item under Q bytes whose words a row holds."""
    if not index.short:
        return
    t, at, origin = plain(data, offsets)
    for r in range(len(at) - 1):
        words = t[at[r] : at[r + 1]].tobytes().split(b" ")
        begin = np.cumsum([0, *(len(w) + 1 for w in words)])
        for n, texts in index.short.items():
            for k in range(len(words) - n + 1):
                for item in texts.get(b" ".join(words[k : k + n]), ()):
                    yield r, item, int(origin[at[r] + begin[k]] - offsets[r]), int(origin[at[r] + begin[k + n] - 2] + 1 - offsets[r])


def search(index: Index, texts: pa.Array) -> dict[tuple[int, int], list]:
    """By row and item of which it holds a segment: start, end, edits, segments."""
    data, offsets = utf8(texts)
    rows: dict[tuple[int, int], list] = {}
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        for r, item, start, end, edits, s in [*((r, index.items[s], x, z, e, s) for r, s, x, z, e in find(index, part, at)), *((r, item, x, z, 0, -1) for r, item, x, z in find_short(index, part, at))]:
            was = rows.setdefault((a + r, item), [start, end, edits, set()])
            was[0], was[1], was[2] = min(was[0], start), max(was[1], end), min(was[2], edits)
            was[3].add(s)
    return rows


def _passes(benchmark: DataFrame, bounds: Bounds) -> Iterator[Broadcast]:
    """Indexes of the items, PASS_BYTES of their texts at a time."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // PASS_BYTES))
    for i in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i) if passes > 1 else items
        some = sorted({(r.item_id, r.text) for r in part.collect()}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(Index.of(some, bounds))


def contaminated(docs: DataFrame, benchmark: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """doc_id, item_id, start, end, edits, n_segments: one row per row of docs and benchmark item of which it holds a segment.

    Texts are compared in lower case (A-Z), with runs of ASCII punctuation and white space as one space. An item is cut into
    overlapping segments of bounds.segment characters, one every bounds.stride, so that a part of both together holds a whole one (a shorter
    item is one segment, and one under Q bytes is found where a row holds just its words); a document holds a segment if a part of it is within
    one edit per bounds.per_edit characters. start and end are bytes of the UTF-8 text around all segments found; edits is the least of a
    segment. Null and empty texts hold nothing; a null item_id or doc_id is reported as null; rows of docs that repeat each report, and
    items that repeat count once; an empty table on either side gives no rows; other columns are ignored. Whole texts are searched;
    items are held in passes of PASS_BYTES.
    """
    out = None
    for sent in _passes(benchmark, bounds):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                rows = search(index, batch.column(1))
                if rows:
                    keys = list(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in keys])), pa.array([index.ids[i] for _, i in keys], pa.int64()), *(pa.array([rows[k][c] for k in keys], pa.int64()) for c in range(3)), pa.array([sum(index.copies[s] if s >= 0 else 1 for s in rows[k][3]) for k in keys], pa.int64())], ["doc_id", "item_id", "start", "end", "edits", "n_segments"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy("decontaminate", run), "doc_id long, item_id long, start long, end long, edits long, n_segments long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """The rows of docs that hold no segment of an item, with the columns of docs.

    Each row is decided by its own text, as contaminated() finds segments, so that nothing is shuffled and a null or repeated doc_id plays
    no part; rows that repeat stay or go alike. Null and empty texts stay. An empty benchmark drops nothing; columns may have any names.
    """
    names, docs = docs.columns, plain_names(docs)
    for sent in _passes(benchmark, bounds):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gone = {r for r, _ in search(sent.value, batch.column(batch.schema.get_field_index("text")))}
                yield batch.take(pa.array([r for r in range(len(batch)) if r not in gone], pa.int64())) if gone else batch

        docs = docs.mapInArrow(tidy("decontaminate", run), docs.schema)
    return docs.toDF(*names)
