"""Similarity join on word shingles with PartEnum signatures, and its connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Scratch, keys64, mix64, partitions, slices, table, tidy, utf8, word_hashes, words
from .components import components

#: First-level partitions per edit of the bound; three second-level cells each, of which signatures take two.
FIRST_LEVEL = 0.55
#: Members of a signature's group or of a cluster, and bytes of a cluster's sets, that one task compares with as many others.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
#: Signatures that a task gathers before it deals them to buckets.
DEAL = 1 << 19
#: Members of a group of which all pairs are compared before links are followed.
SMALL = 12
#: Document ids that a join may broadcast, 8 bytes each.
FEW_IDS = 500_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row as 64-bit hashes, sorted within the row, and their number per row."""
    rows = len(offsets) - 1
    data = LOWER[data]
    start, end, row = words(data, offsets)
    h = word_hashes(data, start, end)
    held = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    keys = keys64(n, 11)
    values, owners = [], []
    if len(h) >= n:
        whole = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            whole += h[j : len(h) - n + 1 + j] * keys[j]
        within = row[: len(h) - n + 1] == row[n - 1 :]
        values.append(mix64(whole[within]))
        owners.append(row[: len(h) - n + 1][within])
    short = (held > 0) & (held < n)
    if short.any():
        begin = np.concatenate(([0], np.cumsum(held)[:-1]))
        place = np.arange(len(h)) - begin[row]
        mine = short[row]
        part = h[mine] * keys64(n, 13)[place[mine]]
        values.append(mix64(np.add.reduceat(part, np.concatenate(([0], np.cumsum(held[short])[:-1]))) + held[short].astype(np.uint64)))
        owners.append(np.flatnonzero(short))
    if not values:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    value, owner = np.concatenate(values), np.concatenate(owners)
    if len(values) > 1:
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    edges = np.searchsorted(owner, np.arange(rows + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=rows)


def set_keys(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 128-bit key of each row's set, as 16 bytes."""
    out = np.zeros((len(counts), 2), np.uint64)
    full = counts > 0
    if full.any():
        begin = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        for i, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
            out[full, i] = np.add.reduceat(mix64(value ^ np.uint64(salt)), begin)
    out[:, 0] = mix64(out[:, 0] + counts.astype(np.uint64))
    return out.view(np.uint8).reshape(-1, 16)


def sketch_bits(counts: np.ndarray, per: int = 1) -> np.ndarray:
    """Bits of a sketch: `per` to twice as many per member, a power of two."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(counts, 1) * per)).astype(np.int64))


def sketches(value: np.ndarray, counts: np.ndarray, per: int = 1) -> list[bytes]:
    """Per row, the parity of its members at each of the sketch's bits: the bits in which two sketches differ are never more than the members in which the sets differ."""
    bits = sketch_bits(counts, per)
    start = np.concatenate(([0], np.cumsum(bits)))
    at = (mix64(value ^ np.uint64(0xD1B54A32D192ED03)) & np.repeat(bits - 1, counts).astype(np.uint64)).astype(np.int64) + np.repeat(start[:-1], counts)
    packed = np.packbits((np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(start[:-1], start[1:])]


class Bands:
    """Size bands whose neighbours hold all sizes that a similarity of num / den allows; instance j joins bands j - 1 and j."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        ends = [1]
        while ends[-1] < 1 << 40:
            ends.append(max(ends[-1] + 1, (ends[-1] + 1) * den // num))
        self.ends = np.array(ends, np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, size)

    def edits(self, instance: np.ndarray) -> np.ndarray:
        """The most members in which two similar sets of the instance differ."""
        return (self.den - self.num) * 2 * self.ends[instance] // (self.num + self.den)

    def own_edits(self, size: np.ndarray) -> np.ndarray:
        """The most members in which any similar set differs from one of that size."""
        return size * (self.den - self.num) // self.num


def signatures(value: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of each row's set (sorted hashes) as 64-bit hashes, and their rows.

    In an instance with an edit bound k, the feature domain is cut into n1 > k / 2 partitions of three cells. At most k / 2 of them hold
    two edits or more, and in any other some two cells are free of edits: the projections on two of three cells are the
    signatures. An empty projection says nothing, and is left out as long as a set has more partitions within the bound than partitions
    with an empty pair of cells, for then some shared projection is not empty. Else the set's empty projections are signatures, too; a
    pair of which both sets are such shares one of those.
    """
    keys = keys64(8, 17)
    out, owners = [], []
    size = counts.astype(np.int64)
    spread = value >> np.uint64(32)  # ascending within a row, as the values are
    member = mix64(value * keys[0])
    for step in (0, 1):
        instance = bands.of(np.maximum(size, 1)) + step
        k = bands.edits(instance)
        first = np.where((size > 0) & (k > 0), np.ceil(FIRST_LEVEL * k).astype(np.int64) + 1, 0)
        start = np.concatenate(([0], np.cumsum(first)))
        if not start[-1]:
            continue
        mine = np.repeat(first > 0, counts)
        cells = np.repeat(3 * first, counts)[mine].astype(np.uint64)
        at = ((spread[mine] * cells) >> np.uint64(32)).astype(np.int64) + np.repeat(3 * start[:-1], counts)[mine]
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        total, filled = np.zeros(3 * start[-1], np.uint64), np.zeros(3 * start[-1], bool)
        total[at[begin]], filled[at[begin]] = np.add.reduceat(member[mine], begin), True
        total, filled = total.reshape(-1, 3), filled.reshape(-1, 3)
        row = np.repeat(np.arange(len(size)), first)
        place = (np.arange(start[-1]) - start[row]).astype(np.uint64) * keys[1] + instance[row].astype(np.uint64) * keys[2]
        thin = np.bincount(row[filled.sum(1) <= 1], minlength=len(size))
        weak = first - np.minimum(k, bands.own_edits(size)) // 2 <= thin
        for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            use = filled[:, a] | filled[:, b] | weak[row]
            out.append(mix64(total[use, a] * keys[3] + total[use, b] * keys[4] + place[use] + keys[5 + i]))
            owners.append(row[use])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owners)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of rows that end at `ends` in data."""
    at = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _fixed(keys: np.ndarray) -> pa.Array:
    return _binary(keys, np.arange(1, len(keys) + 1) * 16)


def short_ids(keys: np.ndarray) -> np.ndarray:
    """The first eight bytes of each set's key: enough to find candidates by."""
    return keys[:, :8].copy().view(np.int64).ravel()


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, digest (MD5 of the text), n_shingles, cls (key of the set), id (its first part), sketch of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in slices(offsets):
                value, counts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                keys = set_keys(value, counts)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(counts, pa.int64()), _fixed(keys), pa.array(short_ids(keys)), pa.array(sketches(value, counts), pa.binary())], ["doc_id", "digest", "n_shingles", "cls", "id", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), "text").mapInArrow(tidy("ngram_join", run), "doc_id long, digest binary, n_shingles long, cls binary, id long, sketch binary")


def text_digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def signature_groups(docs: DataFrame, n: int, bands: Bands, buckets: int) -> DataFrame:
    """gid, m, id: the m different sets that share a signature, each group once.

    A task deals the signatures of each set once, many sets together in one row per bucket, five bytes a signature and eight a set. They are
    dealt by their hash, so that a hot signature or set loads all buckets alike.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of this task's rows
        held, total = [], 0

        def dealt() -> pa.RecordBatch:
            at = np.cumsum([0, *(len(ids) for ids, _, _ in held)])
            ids, sig = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            row = np.concatenate([x[2] + a for x, a in zip(held, at)])
            key = (sig >> np.uint64(40)).astype(np.int64) % buckets * len(ids) + row
            order = np.argsort(key)
            key, low = key[order], sig[order].view(np.uint8).reshape(-1, 8)[:, :5]
            last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            bucket, runs = key[last] // len(ids), np.diff(last, prepend=-1).astype(np.uint32)
            ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True))
            return pa.RecordBatch.from_arrays([pa.array(bucket[ends].astype(np.int32)), _binary(ids[key[last] % len(ids)], (ends + 1) * 8), _binary(runs.astype(np.uint16) if runs.max() < 1 << 16 else runs, (ends + 1) * (2 if runs.max() < 1 << 16 else 4)), _binary(low, (last[ends] + 1) * 5)], ["bucket", "ids", "runs", "sigs"])

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets):
                value, counts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                keys = set_keys(value, counts)
                names = [k.tobytes() for k in keys]
                new = np.array([i for i, k in enumerate(names) if counts[i] and not (k in seen or seen.add(k))], np.int64)
                keep = np.zeros(len(counts), bool)
                keep[new] = True
                sig, row = signatures(value[np.repeat(keep, counts)], counts[new], bands)
                if len(sig):
                    held.append((short_ids(keys[new]), sig, row))
                    total += len(sig)
                if total > DEAL:
                    yield dealt()
                    held, total = [], 0
        if held:
            yield dealt()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lengths, lows = [], [], []
        for batch in batches:
            for ids, runs, low in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                names.append(np.frombuffer(ids, np.int64))
                lengths.append(np.frombuffer(runs, np.uint16 if len(runs) * 4 == len(ids) else np.uint32).astype(np.int64))
                lows.append(np.frombuffer(low, np.uint8))
        if not names:
            return
        ids, index = np.unique(np.concatenate(names), return_inverse=True)
        low = np.zeros((sum(map(len, lows)) // 5, 8), np.uint8)
        low[:, :5] = np.concatenate(lows).reshape(-1, 5)
        sig, who = low.view(np.uint64).ravel(), np.repeat(index, np.concatenate(lengths))
        del low, lows, names
        if len(ids) <= 1 << 24:
            both = np.sort(sig << np.uint64(24) | who.astype(np.uint64))
            sig, who = both >> np.uint64(24), (both & np.uint64((1 << 24) - 1)).astype(np.int64)
        else:
            order = np.lexsort((who, sig))
            sig, who = sig[order], who[order]
        first = np.append(True, sig[1:] != sig[:-1])
        # a signature that stands alone says nothing
        use = (~first | ~np.append(first[1:], True)) & (first | np.append(True, who[1:] != who[:-1]))
        sig, who, first = sig[use], who[use], first[use]
        begin = np.flatnonzero(first)
        if not len(begin):
            return
        held = np.diff(np.append(begin, len(sig)))
        gid = mix64(np.add.reduceat(mix64(ids.view(np.uint64))[who], begin) + held.astype(np.uint64))
        many = np.flatnonzero(held > 1)
        many = many[np.unique(gid[many], return_index=True)[1]]
        for i in range(0, len(many), 4096):
            part = many[i : i + 4096]
            pick = np.repeat(begin[part] - np.concatenate(([0], np.cumsum(held[part])[:-1])), held[part]) + np.arange(held[part].sum())
            group = np.repeat(part, held[part])
            for a in range(0, len(pick), 1 << 16):
                here = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(gid[group[here]].view(np.int64)), pa.array(held[group[here]].astype(np.int64)), pa.array(ids[who[pick[here]]])], ["gid", "m", "id"])

    dealt = docs.select("text").mapInArrow(tidy("ngram_join", deal), "bucket int, ids binary, runs binary, sigs binary")
    return dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy("ngram_join", meet), "gid long, m long, id long").distinct()


def in_blocks(rows: DataFrame, group: str, key: str, blocks: Column) -> DataFrame:
    """rows with i, j, own: a group of several blocks is compared block by block, a row in each pair of blocks that holds its own."""
    own = F.pmod(F.xxhash64(key), blocks).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches that end with a group of their first `keys` columns, and the rows at which groups begin and end. Rows come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, (None,)):
        if batch is not None:
            if not len(batch):
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(keys)], 1)
            if held and (key[-1] == np.array([held[0].column(c)[0].as_py() for c in range(keys)])).all():
                held.append(batch)  # all of one group
                continue
        parts = [*held, *([] if batch is None else [batch])]
        if not parts:
            return
        rows = pa.concat_batches(parts)
        key = np.stack([rows.column(c).to_numpy() for c in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        last = len(cuts) - (1 if batch is None else 2)
        yield rows, cuts[: last + 1]
        held = [rows.slice(cuts[last])] if batch is not None else []


class Near:
    """Rows with sizes and sketches, of which those are asked for that may be similar to one row."""

    def __init__(self, size: np.ndarray, marks: list[bytes], num: int, den: int):
        self.size, self.num, self.den = size, num, den
        self.width = np.array([len(x) // 8 for x in marks], np.int64)
        #: by width of a sketch in words: places of rows, and the sketches of that width and of twice it, folded: halves added
        self.marks = {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero((self.width == w) | (self.width == 2 * w))
            place = np.full(len(marks), -1)
            place[rows] = np.arange(len(rows))
            self.marks[w] = place, np.stack([np.bitwise_xor.reduce(np.frombuffer(marks[k], np.uint64).reshape(-1, w), 0) for k in rows.tolist()])

    def of(self, x: int, rest: np.ndarray) -> np.ndarray:
        """Those of `rest` that may be similar to row x: sizes that are near enough differ by less than a doubling."""
        rest = rest[self.den * np.minimum(self.size[rest], self.size[x]) >= self.num * np.maximum(self.size[rest], self.size[x])]
        found = []
        for w in np.unique(self.width[rest]).tolist():
            part = rest[self.width[rest] == w]
            place, marks = self.marks[min(w, int(self.width[x]))]
            apart = np.bitwise_count(marks[place[part]] ^ marks[place[x]]).sum(1)
            found.append(part[apart * (self.num + self.den) <= (self.size[part] + self.size[x]) * (self.den - self.num)])
        return np.concatenate([*found, np.zeros(0, np.int64)])


def any_near(size: list[int], marks: list[bytes], num: int, den: int) -> bool:
    """Whether any two of a few rows may be similar, by sizes and sketches."""
    bits = [int.from_bytes(x, "little") for x in marks]
    for a in range(len(size)):
        for b in range(a):
            if den * min(size[a], size[b]) >= num * max(size[a], size[b]):
                x, y = (bits[a], bits[b]) if len(marks[a]) <= len(marks[b]) else (bits[b], bits[a])
                half = 8 * min(len(marks[a]), len(marks[b]))
                if len(marks[a]) != len(marks[b]):
                    y = y >> half ^ y & (1 << half) - 1
                if (x ^ y).bit_count() * (num + den) <= (size[a] + size[b]) * (den - num):
                    return True
    return False


def reached(rows: int, linked: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray | None = None) -> list[np.ndarray]:
    """Rows that links join, in lists of two or more: from a row on, those not yet reached are asked for. Each pair is asked for once at most.

    With sides, only rows of different sides are compared.
    """
    free, out, left = np.arange(rows), [], np.ones(rows, bool)
    while len(free):
        queue, free = [int(free[0])], free[1:]
        for x in queue:
            if not len(free):
                break
            new = linked(x, free if side is None else free[side[free] != side[x]])
            if len(new):
                queue += new.tolist()
                left[new] = False
                free = free[left[free]]
        if len(queue) > 1:
            out.append(np.array(queue))
    return out


def maybe_links(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links that join the sets of each group that may be similar, by sizes and sketches, directly or over others.

    No link between sets is lost: both are in one component of the result. A task gives fewer links than it has sets, however many groups
    they share.
    """
    members = groups.join(sets.select("id", "n_shingles", "sketch"), "id")
    dealt = in_blocks(members, "gid", "id", F.ceil(F.col("m") / BLOCK).cast("int")).select("gid", "i", "j", "own", "id", "n_shingles", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}  # of this task's sets: one that each is joined to

        def root(x: int) -> int:
            while (up := joined.setdefault(x, x)) != x:
                joined[x] = x = joined[up]
            return x

        for rows, cuts in _grouped(batches, 3):
            size, own, ids = (rows.column(c).to_numpy() for c in ("n_shingles", "own", "id"))
            i, j, marks = rows.column("i").to_numpy(), rows.column("j").to_numpy(), rows.column("sketch").to_pylist()
            found = []
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z - a > SMALL or any_near(size[a:z].tolist(), marks[a:z], num, den):
                    near = Near(size[a:z], marks[a:z], num, den)
                    for part in reached(z - a, near.of, own[a:z] if i[a] != j[a] else None):
                        first, *rest = ids[a + part].tolist()
                        for x in rest:
                            x, y = sorted((root(first), root(x)))
                            if x != y:
                                joined[y] = x
                                found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return dealt.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(tidy("ngram_join", run), "a long, b long").distinct()


def exact_links(clusters: DataFrame, docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """a, b: links between sets (by key) of a cluster that are similar by their shingles, as many as join what links join.

    clusters: cluster, cls, doc_id and digest (of a row with that set), n_shingles. Only the texts of these are moved; a cluster is compared in blocks.
    """
    held = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    clusters = scratch.table(clusters.join(held, "cluster").select("cluster", "blocks", "cls", F.col("doc_id").alias("of"), F.col("digest").alias("of_digest")), "needed")
    few = F.broadcast(clusters) if clusters.count() <= FEW_IDS else clusters
    # by doc_id and text: a doc_id that many rows repeat meets its own text alone
    texts = docs.select(_some("doc_id").alias("need"), text_digest().alias("need_digest"), "text").join(few, (F.col("need") == F.col("of")) & (F.col("need_digest") == F.col("of_digest")))
    dealt = in_blocks(texts, "cluster", "cls", F.col("blocks")).select("cluster", "i", "j", "own", "cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _grouped(batches, 3):
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z - a > 1:
                    yield from compare(rows.slice(a, z - a))

    def compare(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(rows.column("text"))
        parts = [shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n) for a, b in slices(offsets)]
        value, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        names = utf8(rows.column("cls"))[0].reshape(-1, 16)
        # a row's set is that of its key, but for digests that are alike by chance
        good = (set_keys(value, counts) == names).all(1)
        at = np.concatenate(([0], np.cumsum(counts)))
        near = Near(counts, sketches(value, counts, 4), num, den)

        def similar(x: int, rest: np.ndarray) -> np.ndarray:
            rest = near.of(x, rest[good[rest]]) if good[x] else rest[:0]
            if not len(rest):
                return rest
            mine, held = value[at[x] : at[x + 1]], counts[rest]
            begin = np.concatenate(([0], np.cumsum(held)[:-1]))
            others = value[np.repeat(at[rest] - begin, held) + np.arange(held.sum())]
            same = mine[np.minimum(np.searchsorted(mine, others), len(mine) - 1)] == others
            both = np.add.reduceat(same.astype(np.int64), begin)
            return rest[den * both >= num * (len(mine) + held - both)]

        sides = rows.column("own").to_numpy() if rows.column("i")[0] != rows.column("j")[0] else None
        for part in reached(len(counts), similar, sides):
            least = min(part.tolist(), key=lambda k: names[k].tobytes())
            yield pa.RecordBatch.from_arrays([_fixed(np.repeat(names[least][None], len(part), 0)), _fixed(names[part])], ["a", "b"])

    return dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(tidy("ngram_join", run), "a binary, b binary").where("a != b")


def _some(doc_id: str) -> Column:
    """A doc_id, the least number for null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def labelled_rows(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, digest, n_shingles, stays (the doc_id and digest of the row that stands for the component, null for a row that links with nothing) of each row of docs."""
    spark, bands = docs.sparkSession, Bands(num, den)
    scratch = Scratch(spark, "join")
    rows = table(set_table(docs, n), "join-rows")
    try:
        best = F.struct(_some("doc_id").alias("doc_id"), "digest")
        sets = rows.where("n_shingles > 0").groupBy("cls").agg(F.min(best).alias("least"), F.first("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
        sets = scratch.table(sets, "sets")
        groups = scratch.table(signature_groups(docs, n, bands, partitions(spark)), "groups")
        maybe = components(scratch.table(maybe_links(groups, sets, num, den), "maybe"), scratch)
        clusters = maybe.select(F.col("node").alias("id"), F.col("root").alias("cluster")).unionByName(maybe.select(F.col("root").alias("id"), F.col("root").alias("cluster")).distinct())
        clusters = clusters.join(sets, "id").select("cluster", "cls", F.col("least.doc_id").alias("doc_id"), F.col("least.digest").alias("digest"), "n_shingles")
        roots = components(scratch.table(exact_links(clusters, docs, n, num, den, scratch), "links"), scratch)
        rooted = sets.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", "copies", F.coalesce("root", "cls").alias("root"))
        by_root = rooted.groupBy("root").agg(F.min("least").alias("stays"), F.sum("copies").alias("size")).where("size > 1")
        # a document alone is its own component
        labels = table(rooted.join(by_root, "root").select(F.col("cls").alias("of"), "stays"), "join-labels")
    finally:
        scratch.drop()
    return rows.select("doc_id", "digest", "n_shingles", "cls").join(labels, (F.col("cls") == F.col("of")) & (F.col("n_shingles") > 0), "left").select("doc_id", "digest", "n_shingles", "stays")


def similar_components(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links of similarity num / den reach, or its own) of each row of docs.

    Words are runs without white space with A-Z in lower case; a set holds the distinct n-word shingles, or the whole sequence where
    there are fewer words. A null, empty or blank text has an empty set and links with nothing. Equal sets are one class at once; classes
    that share a PartEnum signature are candidates. Candidates whose sizes and sketches allow a link form clusters, within which the sets
    themselves are compared, in blocks, so that no link is missed. Rows that repeat stand together. A null doc_id sorts as the least. An empty
    table gives no rows; other columns are ignored.
    """
    label = F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.nullif("stays.doc_id", F.lit(-(1 << 63))))
    return labelled_rows(docs, n, num, den).select("doc_id", "n_shingles", label.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row of each component of docs, with the columns of docs: that of the least doc_id, null being the least, and then of the least digest of its text.

    Each row is decided by its own doc_id and text. Rows without words stand for themselves and stay. Of rows that repeat doc_id and text, one stays. Long
    texts are read whole; an empty table gives no rows; columns of docs may have any names.
    """
    found = labelled_rows(docs, n, num, den).where("stays IS NOT NULL").select(_some("doc_id").alias("doc_id"), "digest", "stays")
    stays = (F.col("stays.doc_id") == F.col("doc_id")) & (F.col("stays.digest") == F.col("digest"))
    keys = table(found.groupBy("doc_id", "digest").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1"), "join-gone")
    count, twice = keys.agg(F.count(F.lit(1)), F.count(F.when(F.col("stays"), 1))).first()
    few = F.broadcast(keys) if count <= FEW_IDS else keys
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _some("doc_id").alias("own_id"), text_digest().alias("own_digest"))
    same = (F.col("own_id") == F.col("doc_id")) & (F.col("own_digest") == F.col("digest"))
    out = whole.join(few, same, "left_anti").select("row")
    if twice:  # one of the rows that repeat
        again = Window.partitionBy("own_id", "own_digest").orderBy(F.xxhash64("row"))
        out = out.unionByName(whole.join(few.where("stays"), same, "left_semi").withColumn("nth", F.row_number().over(again)).where("nth = 1").select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
