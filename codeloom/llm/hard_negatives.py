"""Hard-negative mining: a dual-tree search, with trees over anchors and candidates and bounds of inner products between their nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: Rows of the sample that the upper tree is fitted on, and of a leaf of it.
SAMPLE, SAMPLE_LEAF = 8192, 64
#: Rows that a task splits into blocks at once, of a block, of a leaf of the anchors' tree, and of a node that may hold several labels.
CHUNK, BLOCK, ANCHOR_LEAF, MIXED = 1 << 16, 1024, 256, 64
#: Rows of a part of the candidates and of the anchors: a cell of the search is one of each.
PART_ROWS, ANCHOR_ROWS = 1 << 19, 1 << 16
#: Components are cut at this size, so that they fit 32 bits and scores fit a long.
MOST = 1 << 28
#: Finds a slot that a task holds, on average over a leaf of anchors, before it keeps the best of them.
HELD = 40
_LAST = np.iinfo(np.int64).max  # stands for no vec_id, and sorts last

ROWS = "uid long, vec_id long, label long, v binary, extra binary"
BLOCKS = "part int, n int, width int, uid binary, vec_id binary, label binary, v binary, extra binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id (null: the largest number), label, v (doubles) of the rows that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("label IS NOT NULL AND embedding IS NOT NULL").where(good)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.coalesce("vec_id", F.lit(int(_LAST))).alias("vec_id"), label.alias("label"), F.col("embedding").alias("v"))


def whole(v: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component."""
    return np.clip(np.floor(256.0 * v), -MOST, MOST)


class Splits:
    """The upper tree: a direction and a threshold per inner node, fitted on a bounded sample. It only groups rows; any grouping gives the same result."""

    def __init__(self, sample: np.ndarray, leaf: int = SAMPLE_LEAF):
        self.width = sample.shape[1]
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf))))
        self.direction, self.threshold = np.zeros((1 << self.depth, self.width)), np.zeros(1 << self.depth)
        self._fit(sample, 1)

    def _fit(self, rows: np.ndarray, node: int) -> None:
        if node >= 1 << self.depth:
            return
        if len(rows) > 1:
            far = rows[np.argmax(((rows - rows.mean(0)) ** 2).sum(1))]
            self.direction[node] = far - rows[np.argmax(((rows - far) ** 2).sum(1))]
        at = rows @ self.direction[node]
        self.threshold[node] = np.median(at) if len(rows) else 0.0
        self._fit(rows[at <= self.threshold[node]], 2 * node)
        self._fit(rows[at > self.threshold[node]], 2 * node + 1)

    def leaf(self, v: np.ndarray) -> np.ndarray:
        v = v[:, : self.width] if v.shape[1] >= self.width else np.pad(v, ((0, 0), (0, self.width - v.shape[1])))
        node = np.ones(len(v), np.int64)
        for _ in range(self.depth):
            node = 2 * node + ((v * self.direction[node]).sum(1) > self.threshold[node])
        return node - (1 << self.depth)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists as rows, padded with zeros: a component that is not there adds nothing to a score."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))))
    length = np.diff(ends)
    out = np.zeros((len(lists), int(length.max(initial=0))))
    row = np.repeat(np.arange(len(lists)), length)
    out[row, np.arange(len(flat)) - ends[row]] = flat
    return out


def _binary(v: np.ndarray) -> pa.Array:
    """Each row's components in 32 bits."""
    v = np.ascontiguousarray(v, np.int32)
    return pa.array([x.tobytes() for x in v], pa.binary())


def _fill(v: list[bytes]) -> np.ndarray:
    if len({len(x) for x in v}) == 1:
        return np.frombuffer(b"".join(v), np.int32).reshape(len(v), -1)
    rows = [np.frombuffer(x, np.int32) for x in v]
    out = np.zeros((len(rows), max((len(x) for x in rows), default=0)), np.int32)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def placed(rows: DataFrame, splits: Splits) -> DataFrame:
    """leaf and ROWS of rows (vec_id, label, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = whole(_matrix(batch.column(2)))
            none = pa.nulls(len(batch), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(splits.leaf(v)), pa.nulls(len(batch), pa.int64()), batch.column(0), batch.column(1), _binary(v), none], ["leaf", "uid", "vec_id", "label", "v", "extra"])

    return rows.mapInArrow(run, f"leaf long, {ROWS}")


def split(v: np.ndarray, label: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows in groups of at most `most` in order of a tree: a node of over MIXED rows is cut between two labels, near the middle, else one of over `most` at the median of its widest component."""
    waiting, out = [np.argsort(label, kind="stable")], []
    while waiting:
        part = waiting.pop()
        own = label[part]
        if len(part) > MIXED and own[0] != own[-1]:
            half = len(part) // 2
            ends = np.searchsorted(own, own[half], "left"), np.searchsorted(own, own[half], "right")
            half = int(min((e for e in ends if 0 < e < len(part)), key=lambda e: abs(e - half)))
        elif len(part) <= most:
            out.append(part)
            continue
        else:
            x = v[part]
            # one label, or few rows: these stay in order of labels
            part = part[np.argsort(x[:, np.argmax(x.max(0).astype(np.int64) - x.min(0))] if x.shape[1] else np.zeros(len(part)), kind="stable")]
            half = len(part) // 2
        waiting += [part[half:], part[:half]]
    return out


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """BLOCKS of rows (leaf, ROWS): parts are ranges of leaves, so that a part's rows lie together; a hot leaf has several parts. Rows without a uid get one."""
    dealt = rows.repartitionByRange(parts, "leaf", F.xxhash64("vec_id", "label", "v")).sortWithinPartitions("leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, held, count = TaskContext.get().partitionId(), 0, [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            table = pa.Table.from_batches(held)
            v = _fill(table.column("v").to_pylist())
            ids, labels, extra = (table.column(c).to_pylist() if c == "extra" else table.column(c).to_numpy() for c in ("vec_id", "label", "extra"))
            uid = table.column("uid").to_numpy() if table.column("uid").null_count == 0 else (part << 40) + seen + np.arange(len(v))
            seen += len(v)
            narrow = v.astype(np.int16) if np.abs(v).max(initial=0) < 1 << 15 else v
            for group in split(v, labels, BLOCK):
                row = {"part": part, "n": len(group), "width": v.shape[1], "uid": uid[group].tobytes(), "vec_id": ids[group].tobytes(), "label": labels[group].tobytes(), "v": narrow[group].tobytes(), "extra": None if extra[0] is None else b"".join(extra[k] for k in group)}
                yield pa.RecordBatch.from_pylist([row], _BLOCKS)

        for batch in batches:
            for a in range(0, len(batch), CHUNK):
                held.append(batch.slice(a, CHUNK))
                count += len(held[-1])
                if count >= CHUNK:
                    yield from blocks()
                    held, count = [], 0
        if count:
            yield from blocks()

    return dealt.select("uid", "vec_id", "label", "v", "extra").mapInArrow(run, BLOCKS)


_BLOCKS = pa.schema([(f.split()[0], {"int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in BLOCKS.split(", ")])


def anchor_rows(blocks: DataFrame, splits: Splits, every: int) -> DataFrame:
    """leaf and ROWS of the rows of blocks whose vec_id is divisible by `every`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uid, ids, labels, v = _opened(row)
                use = np.flatnonzero((ids % every == 0) & (ids != _LAST))
                if len(use):
                    yield pa.RecordBatch.from_arrays([pa.array(splits.leaf(v[use])), pa.array(uid[use]), pa.array(ids[use]), pa.array(labels[use]), _binary(v[use]), pa.nulls(len(use), pa.binary())], ["leaf", "uid", "vec_id", "label", "v", "extra"])

    return blocks.mapInArrow(run, f"leaf long, {ROWS}")


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(row["v"]) // max(1, row["n"] * row["width"]) or 8]
    return tuple(np.frombuffer(row[c], np.int64) for c in ("uid", "vec_id", "label")) + (np.frombuffer(row["v"], kind).reshape(row["n"], row["width"]),)


class Tree:
    """A binary tree over rows in an order in which each node is a run of rows, with the least and greatest component, the least and greatest label and the greatest norm of each node."""

    def __init__(self, v: np.ndarray, label: np.ndarray, leaf: int):
        groups = split(v, label, leaf)
        self.order = np.concatenate(groups)
        ends = np.cumsum([0, *(len(g) for g in groups)])
        # single precision where it holds each component
        self.v = v[self.order].astype(np.float32 if np.abs(v).max(initial=0) <= 1 << 24 else np.float64)
        self.label, self.size = label[self.order], np.sqrt(np.einsum("ij,ij->i", self.v, self.v, dtype=np.float64)) * (1 + 1e-6)
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, last row + 1, children (-1: a leaf)
        self.low, self.high, self.labels, self.norm = [], [], [], []
        self._build(ends, 0, len(groups))

    def _build(self, ends: np.ndarray, a: int, z: int) -> int:
        here, first, last = len(self.nodes), int(ends[a]), int(ends[z])
        self.nodes.append((first, last, -1, -1))
        self.low.append(self.v[first:last].min(0).astype(np.float64))
        self.high.append(self.v[first:last].max(0).astype(np.float64))
        self.labels.append((int(self.label[first:last].min()), int(self.label[first:last].max())))
        self.norm.append(float(self.size[first:last].max()))
        if z - a > 1:
            left, right = self._build(ends, a, (a + z) // 2), self._build(ends, (a + z) // 2, z)
            self.nodes[here] = (first, last, left, right)
        return here


def interval(low_a: np.ndarray, high_a: np.ndarray, low_c: np.ndarray, high_c: np.ndarray) -> tuple[float, float]:
    """What inner products of rows of two nodes lie between."""
    corners = np.stack([low_a * low_c, low_a * high_c, high_a * low_c, high_a * high_c])
    slack = 1e-9 * float(np.abs(corners).max(0).sum())  # sums of doubles
    return float(corners.min(0).sum()) - slack, float(corners.max(0).sum()) + slack


def scores(a: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of whole components. bound: of the sum of the sizes of a product's terms, which tells in what numbers each sum is exact."""
    if bound < 2.0**24:
        return a.astype(np.float32, copy=False) @ c.astype(np.float32, copy=False).T
    if bound < 2.0**53:
        return a.astype(np.float64, copy=False) @ c.astype(np.float64, copy=False).T
    return a.astype(np.int64) @ c.astype(np.int64).T


class Search:
    """The anchors of a cell, of which each wants (by slot) the first `keep` rows of some kind by score, then vec_id.

    floor: the least score that a slot still has use for; ceiling: the greatest that it takes. Both stand per anchor and slot, and rise or stay.
    least, most: of these, per anchor.
    """

    def __init__(self, anchors: list[dict], keep: int, same: bool):
        width = max(r["width"] for r in anchors)
        parts = [_opened(r) for r in anchors]
        v = np.concatenate([np.pad(p[3], ((0, 0), (0, width - p[3].shape[1]))) for p in parts])
        self.keep, self.same, self.tree = keep, same, Tree(v, np.concatenate([p[2] for p in parts]), ANCHOR_LEAF)
        self.uid, self.ids, self.label = (np.concatenate([p[k] for p in parts])[self.tree.order] for k in range(3))
        if same:
            self.floor = np.full((len(v), 1), np.iinfo(np.int64).min)
            self.ceiling = np.full((len(v), 1), np.iinfo(np.int64).max)
        else:
            extra = np.concatenate([np.frombuffer(r["extra"], np.int64).reshape(r["n"], -1, 2) for r in anchors])[self.tree.order]
            self.floor, self.ceiling = extra[:, :, 0].copy(), extra[:, :, 1].copy()
        self.wants = self.floor <= self.ceiling
        self.floor[~self.wants], self.ceiling[~self.wants] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        self.least, self.most = self.floor.min(1), self.ceiling.max(1)
        # by the first anchor of a leaf: the last one + 1, and tables of anchor * slots + slot, score, vec_id, uid
        self.found: dict[int, tuple[int, list[np.ndarray]]] = {a: (z, []) for a, z, left, _ in self.tree.nodes if left < 0}

    def meet(self, block: dict) -> None:
        """Descend both trees from their roots. A pair of nodes whose labels or interval no slot of the anchors has use for is left, with all anchors below."""
        uid, ids, label, v = _opened(block)
        width = max(v.shape[1], self.tree.v.shape[1])
        tree = Tree(v, label, BLOCK)
        uid, ids, label = uid[tree.order], ids[tree.order], tree.label
        wide = lambda x: x if x.shape[-1] == width else np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, width - x.shape[-1])])
        waiting = [(0, 0)]
        while waiting:
            a, c = waiting.pop()
            a0, a1, *a_below = self.tree.nodes[a]
            c0, c1, *c_below = tree.nodes[c]
            (l0, l1), (m0, m1) = self.tree.labels[a], tree.labels[c]
            if l1 < m0 or m1 < l0 if self.same else l0 == l1 == m0 == m1:
                continue
            low, high = interval(wide(self.tree.low[a]), wide(self.tree.high[a]), wide(tree.low[c]), wide(tree.high[c]))
            if not (self.wants[a0:a1] & (self.floor[a0:a1] <= high) & (self.ceiling[a0:a1] >= low)).any():
                continue
            if a_below[0] < 0 and c_below[0] < 0:
                # the sum of the sizes of a product's terms is at most the product of the norms
                self._leaves(a0, a1, scores(wide(self.tree.v[a0:a1]), wide(tree.v[c0:c1]), self.tree.norm[a] * tree.norm[c]), uid[c0:c1], ids[c0:c1], label[c0:c1])
            elif c_below[0] < 0 or (a_below[0] >= 0 and a1 - a0 >= c1 - c0):
                waiting += [(x, c) for x in a_below]
            else:
                waiting += [(a, x) for x in c_below]

    def _leaves(self, a0: int, a1: int, s: np.ndarray, uid: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
        slots, own = self.floor.shape[1], self.label[a0:a1]
        if self.same and s.shape[1] > 4 * self.keep and own[0] == own[-1] == label[0] == label[-1] and not self.found[a0][1]:
            # the first rows of the label: of the first keep + 1 scores one may be the anchor's own
            first = np.partition(s, -self.keep - 1, axis=1)[:, -self.keep - 1]
            self.floor[a0:a1, 0] = self.least[a0:a1] = np.maximum(self.least[a0:a1], first.astype(np.int64))
        at = np.flatnonzero(s >= self.least[a0:a1].astype(s.dtype)[:, None])
        if not len(at):
            return
        row, column = np.divmod(at, s.shape[1])
        score = s.reshape(-1)[at].astype(np.int64)
        alike = own[row] == label[column]
        use = (alike & (self.uid[a0 + row] != uid[column]) if self.same else ~alike) & (score <= self.most[a0 + row])
        row, column, score = a0 + row[use], column[use], score[use]
        held = self.found[a0][1]
        for k in range(slots):
            use = np.flatnonzero((score >= self.floor[row, k]) & (score <= self.ceiling[row, k]))
            if len(use):
                held.append(np.stack([row[use] * slots + k, score[use], ids[column[use]], uid[column[use]]], 1))
        if sum(map(len, held)) > HELD * slots * (a1 - a0):
            self._best(a0)

    def _best(self, a0: int) -> np.ndarray:
        """The first `keep` finds of each slot of a leaf's anchors; floors rise to the last of a full slot."""
        a1, held = self.found[a0]
        rows = np.concatenate(held) if held else np.zeros((0, 4), np.int64)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        rows, nth = _first(rows, rows[:, 0], self.keep)
        full = nth == self.keep - 1
        slot = rows[full, 0]
        self.floor.reshape(-1)[slot] = np.maximum(self.floor.reshape(-1)[slot], rows[full, 1])
        self.least[a0:a1] = self.floor[a0:a1].min(1)
        held[:] = [rows]
        return rows

    def best(self) -> None:
        for a0 in self.found:
            self._best(a0)

    def results(self) -> pa.RecordBatch:
        """A row for each find."""
        rows, slots = np.concatenate([self._best(a0) for a0 in self.found]), self.floor.shape[1]
        anchor = rows[:, 0] // slots
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.uid[anchor], self.ids[anchor], rows[:, 0] % slots, rows[:, 2], rows[:, 3], rows[:, 1])], _FOUND[:-1])

    def finds(self) -> Iterator[pa.RecordBatch]:
        """A row for each anchor with finds: slot, score, vec_id and uid of each, one after the other."""
        slots = self.floor.shape[1]
        for a0 in self.found:
            rows = self._best(a0)
            if len(rows):
                anchor, begin = np.unique(rows[:, 0] // slots, return_index=True)
                rows[:, 0] %= slots
                raw, ends = rows.tobytes(), np.append(begin, len(rows)) * 32
                yield pa.RecordBatch.from_arrays([pa.array(self.uid[anchor]), pa.array(self.ids[anchor]), pa.array([raw[x:y] for x, y in zip(ends[:-1], ends[1:])], pa.binary())], _MET)


_MET = ["anchor_uid", "anchor_id", "finds"]
_FOUND = ["anchor_uid", "anchor_id", "slot", "vec_id", "uid", "score", "nth"]


def _first(rows: np.ndarray, key: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `keep` rows of each run of equal keys, and their places in it."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    nth = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    return rows[nth < keep], nth[nth < keep]


def merged(met: DataFrame, keep: int) -> DataFrame:
    """anchor_uid, anchor_id, slot, vec_id, uid, score, nth (from 1): the first `keep` finds of each anchor and slot over all cells."""

    def best(batch: pa.Table) -> pa.RecordBatch:
        said = batch.column("finds").to_pylist()
        rows = np.frombuffer(b"".join(said), np.int64).reshape(-1, 4)
        of = np.repeat(np.arange(len(said)), [len(x) // 32 for x in said])
        uid, ids = (batch.column(c).to_numpy()[of] for c in ("anchor_uid", "anchor_id"))
        rows = np.column_stack([uid, ids, rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 1]])
        rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 5], rows[:, 2], rows[:, 0]))]
        # runs of an anchor's slot
        run = np.cumsum(np.append(0, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])))[: len(rows)]
        rows, nth = _first(rows, run, keep)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(6)] + [pa.array(nth + 1)], _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one anchor, which the next batch may go on with
        for batch in batches:
            uid = batch.column(0).to_numpy()
            if not len(uid):
                continue
            last = int(np.searchsorted(uid, uid[-1]))
            if last or held and held[0].column(0)[0].as_py() != uid[0]:
                yield best(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield best(pa.Table.from_batches(held))

    dealt = met.repartition(partitions(met.sparkSession), "anchor_uid").sortWithinPartitions("anchor_uid")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in _FOUND))


def search(anchors: DataFrame, candidates: DataFrame, keep: int, same: bool, chunks: int, parts: int) -> DataFrame:
    """anchor_uid, anchor_id, slot, vec_id, uid, score, nth: the first `keep` candidates of each anchor and slot.

    A cell is a part of the anchors against a part of the candidates; its task holds these anchors and reads block by block of the candidates. Each cell gives
    a row an anchor at most, with its first `keep` finds a slot, of which the first over all cells remain.
    """
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod("part", F.lit(n))
    rows = anchors.select(own(chunks).alias("chunk"), each(parts).alias("with"), F.lit(0).alias("second"), *_KEPT).unionByName(candidates.select(each(chunks).alias("chunk"), own(parts).alias("with"), F.lit(1).alias("second"), *_KEPT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], None
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if (row["chunk"], row["with"]) != now:
                    if found is not None:
                        yield from found.finds()
                    now, held, found = (row["chunk"], row["with"]), [], None
                if row["second"] == 0:
                    held.append(row)
                    continue
                if not held:
                    continue
                if found is None:
                    found = Search(held, keep, same)
                found.meet(row)
        if found is not None:
            yield from found.finds()

    met = rows.repartition(parts * chunks, "chunk", "with").sortWithinPartitions("chunk", "with", "second")
    return merged(met.mapInArrow(run, "anchor_uid long, anchor_id long, finds binary"), keep)


_KEPT = ["n", "width", "uid", "vec_id", "label", "v", "extra"]


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of the rows of embeddings (vec_id, embedding, label) whose vec_id is divisible by `every`.

    An anchor's positives are its first other rows of its label by inner product of whole components, ties by smaller vec_id; the negatives of each are
    the first rows of other labels with a score of `least` to `most` hundredths of the positive's. Two searches run: positives first, whose scores bound the second.
    Rows that repeat are rows of their own; a vec_id that is null sorts last and is no anchor; a shorter vector has zeros at its end; components of more than
    2^20 in size are cut there; rows with a null label or vector or a component that is null or not finite take no part; an empty table gives no rows; other
    columns are ignored.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = usable(embeddings)
    sample = rows.select("v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toArrow().column("v").combine_chunks()
    splits = Splits(whole(_matrix(sample)) if len(sample) else np.zeros((0, 0)))
    n, wanting = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    # cells of bounded work, and enough of them for all cores: what a cell gives is held by anchor, so more parts than that cost more than they save
    chunks = max(1, -(-wanting // ANCHOR_ROWS))
    parts = max(1, -(-n // PART_ROWS), min(-(-4 * spark.sparkContext.defaultParallelism // chunks), -(-n // BLOCK)))
    candidates = scratch.table(packed(placed(rows, splits), parts * max(1, -(-partitions(spark) // parts))), "candidates")
    anchors = scratch.table(anchor_rows(candidates, splits, every), "anchors")
    first = scratch.table(search(packed(anchors, chunks), candidates, positives, True, chunks, parts), "positives")
    # per anchor and positive: the least and the greatest score of a negative, and of a positive that is not there a range that holds none
    s = F.col("score").cast("decimal(38,0)")
    bounds = first.groupBy("anchor_uid").agg(*[F.struct(F.coalesce(F.max(F.when(F.col("nth") == k + 1, F.ceil(s * least / 100))).cast("long"), F.lit(1).cast("long")).alias("low"), F.coalesce(F.max(F.when(F.col("nth") == k + 1, F.floor(s * most / 100))).cast("long"), F.lit(0).cast("long")).alias("high")).alias(f"b{k}") for k in range(positives)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            extra = np.stack([x.field(f).to_numpy() for c in range(positives) for x in [batch.column(f"b{c}")] for f in ("low", "high")], 1).astype(np.int64)
            columns = {c: table.column(c) for c in ("leaf", "uid", "vec_id", "label", "v")} | {"extra": pa.array([x.tobytes() for x in extra], pa.binary())}
            yield from pa.table(columns).to_batches()

    wanted = anchors.drop("extra").join(bounds, F.col("uid") == F.col("anchor_uid")).select("leaf", "uid", "vec_id", "label", "v", *[f"b{k}" for k in range(positives)]).mapInArrow(run, f"leaf long, {ROWS}")
    second = search(packed(wanted, chunks), candidates, negatives, False, chunks, parts)
    said = first.select(F.col("anchor_uid").alias("of"), (F.col("nth") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = second.join(said, (F.col("anchor_uid") == F.col("of")) & (F.col("slot") == F.col("place")))
    named = lambda c: F.when(F.col(c) != int(_LAST), F.col(c))
    return out.select("anchor_id", named("positive_id").alias("positive_id"), F.col("nth").cast("int").alias("rank"), named("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: DuckDB SQL of the query's rows.
ORACLE = """
WITH rows AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.uid AS anchor_uid, a.vec_id AS anchor_id, r.uid, r.vec_id, a.label = r.label AS alike, list_dot_product(a.v, r.v)::BIGINT AS score FROM rows a JOIN rows r ON a.uid != r.uid WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM pairs WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_uid ORDER BY score DESC, vec_id, uid) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_uid, p.uid ORDER BY n.score DESC, n.vec_id, n.uid))::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_uid = n.anchor_uid AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_uid, p.uid ORDER BY n.score DESC, n.vec_id, n.uid) <= 10
"""
