"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix64, slices, utf8, word_hashes, words
from .labelled import fold, training_sample

#: Words of a passage; hashed byte pairs of its encoding; buckets of its words, each of which has an embedding; labelled rows to learn from.
PASSAGE, PAIRS, BUCKETS, TRAINING_ROWS = 64, 24, 256, 8000
#: Kinds of bytes that are counted: A-Z, a-z, digits, plain punctuation, other ASCII signs, "!", "|", bytes of other letters, line ends.
_KINDS = 9
_KIND = np.full(256, -1, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 3
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 4
_KIND[ord("!")], _KIND[ord("|")], _KIND[10] = 5, 6, 8
#: The largest feature: words of 80 letters on average.
LONGEST = 8.0
SHARES = _KINDS + 9 + PAIRS
WIDTH = SHARES + BUCKETS


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the number of passages of each row; a row without words has one passage of zeros.

    Shares of byte kinds; mean and spread of word lengths; shares of words with a capital, of two letters at most, that end in a sign, that
    repeat in the passage, that repeat the word before; share of five-word runs seen elsewhere in the row; passage length; byte pairs. Then the
    share of the passage's words (A-Z in lower case) in each hash bucket: times the encoder's first layer, the mean of its words' embeddings.
    """
    rows = len(offsets) - 1
    start, end, row = words(data, offsets)
    held = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    per_row = np.maximum(1, -(-held // PASSAGE))
    out = np.zeros((int(per_row.sum()), WIDTH), np.float32)
    if not len(start):
        return out, per_row
    first = np.concatenate(([0], np.cumsum(per_row)[:-1]))
    begin = np.concatenate(([0], np.cumsum(held)[:-1]))
    passage = first[row] + (np.arange(len(row)) - begin[row]) // PASSAGE
    size = np.bincount(passage, minlength=len(out)).astype(np.float64)
    mean = lambda x: np.bincount(passage, x, len(out)) / np.maximum(size, 1)
    length = (end - start).astype(np.float64)
    # bytes belong to the passage of the last word that began
    of = passage[np.clip(np.searchsorted(start, np.arange(len(data)), "right") - 1, 0, None)]
    kinds = _KIND[data]
    seen = kinds >= 0
    counts = np.bincount(of[seen] * _KINDS + kinds[seen], minlength=len(out) * _KINDS).reshape(-1, _KINDS)
    total = np.maximum(np.bincount(of, minlength=len(out)), 1)[:, None]
    out[:, :_KINDS] = counts / total
    h = word_hashes(data, start, end)
    order = np.lexsort((h, passage))
    twice = np.zeros(len(h))
    twice[order[1:]] = (h[order][1:] == h[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    five = np.zeros(len(h))
    if len(h) >= 5:
        run = h[:-4] + 3 * h[1:-3] + 5 * h[2:-2] + 7 * h[3:-1] + 11 * h[4:]
        within = np.flatnonzero(row[:-4] == row[4:])
        order = within[np.lexsort((run[within], row[within]))]
        same = (run[order][1:] == run[order][:-1]) & (row[order][1:] == row[order][:-1])
        five[order[1:]] = same
        five[order[:-1]] = np.maximum(five[order[:-1]], same)
    average = mean(length)
    capital = (data[start] >= 65) & (data[start] <= 90)
    sign = _KIND[data[end - 1]]
    for i, x in enumerate((average / 10, np.sqrt(np.maximum(0, mean(length**2) - average**2)) / 10, mean(capital), mean(length <= 2), mean((sign >= 3) & (sign <= 6)), mean(twice), mean(again), mean(five), size / PASSAGE)):
        # lengths of words that no language has say no more than long ones, and would not fit half precision
        out[:, _KINDS + i] = np.minimum(x, LONGEST)
    pair = mix64(data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << np.uint64(8)) % np.uint64(PAIRS)
    out[:, SHARES - PAIRS : SHARES] = np.bincount(of[:-1] * PAIRS + pair.astype(np.int64), minlength=len(out) * PAIRS).reshape(-1, PAIRS) / total
    bucket = (word_hashes(LOWER[data], start, end) % np.uint64(BUCKETS)).astype(np.int64)
    out[:, SHARES:] = np.bincount(passage * BUCKETS + bucket, minlength=len(out) * BUCKETS).reshape(-1, BUCKETS) / np.maximum(size, 1)[:, None]
    return out, per_row


class Attention:
    """Encoder, gated attention and classifier: h = tanh(x A), weight ~ exp(tanh(h V) * sigmoid(h U) . w), score = sigmoid(sum(weight h) . c)."""

    SHAPES = {"A": (WIDTH, 24), "a": (24,), "V": (24, 12), "U": (24, 12), "w": (12,), "c": (24,), "d": ()}

    def __init__(self, mean: np.ndarray, scale: np.ndarray, p: dict[str, np.ndarray]):
        self.mean, self.scale, self.p = mean, scale, p

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p, at = self.p, np.concatenate(([0], np.cumsum(counts)[:-1]))
        h = np.tanh(x @ p["A"] + p["a"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        weight = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(h * weight[:, None], at)
        return {"h": h, "v": v, "u": u, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def gradient(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, counts)
        at = np.concatenate(([0], np.cumsum(counts)[:-1]))
        e = (f["score"] - label) / len(label)
        dz = np.repeat(e[:, None] * p["c"], counts, 0)
        dweight = (dz * f["h"]).sum(1)
        de = f["weight"] * (dweight - np.repeat(np.add.reduceat(f["weight"] * dweight, at), counts))
        dvu = de[:, None] * p["w"]
        dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
        dh = (dz * f["weight"][:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return {"A": x.T @ dh, "a": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ e, "d": e.sum()}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, counts)["score"] if len(counts) else np.zeros(0)

    @classmethod
    def fit(cls, x: np.ndarray, counts: np.ndarray, label: np.ndarray, epochs: int = 30, batch: int = 256, decay: float = 1e-4) -> Attention:
        rng = np.random.default_rng(5)
        mean, scale = x.mean(0, dtype=np.float64).astype(np.float32), x.std(0, dtype=np.float64).astype(np.float32) + np.float32(1e-3)
        scale[SHARES:] = 1 / PASSAGE  # one word of a passage
        x = x - mean
        x /= scale
        net = cls(mean, scale, {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s) for k, s in cls.SHAPES.items()})
        net.p["w"], net.p["c"] = rng.normal(0, 0.3, 12), rng.normal(0, 0.3, 24)
        at = np.concatenate(([0], np.cumsum(counts)))
        m, v, t = {k: np.zeros(s) for k, s in cls.SHAPES.items()}, {k: np.zeros(s) for k, s in cls.SHAPES.items()}, 0
        steps = epochs * -(-len(counts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(counts))
            for i in range(0, len(order), batch):
                pick, t = order[i : i + batch], t + 1
                rows = np.concatenate([np.arange(at[j], at[j + 1]) for j in pick])
                g = net.gradient(x[rows], counts[pick], label[pick])
                rate = 0.01 * (1 - t / (steps + 1))
                for k in g:
                    grad = g[k] + decay * net.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                    net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, most: int = TRAINING_ROWS) -> Attention | None:
    """The network from at most `most` labelled rows outside the held-out fold; executors encode their passages. None without labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets):
                x, counts = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([x[i:j].astype(np.float16).tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], ["label", "x"])

    sample = training_sample(docs, labels, label, folds, held_out, most).select("text", F.col("label").cast("int").alias("label"))
    rows = sorted((bytes(r.x), r.label) for r in sample.mapInArrow(run, "label int, x binary").collect())
    if not rows:
        return None
    # half precision until here: the sample is the driver's largest array
    counts, y = np.array([len(r) // (2 * WIDTH) for r, _ in rows]), np.array([y for _, y in rows], float)
    x = np.frombuffer(b"".join([r for r, _ in rows]), np.float16).reshape(-1, WIDTH).astype(np.float32)
    del rows
    return Attention.fit(x, counts, y)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of each row of docs.

    All passages of a text are encoded and weighed; a null, empty or blank text is one passage of zeros. Without labelled rows, every
    score is 0.5. labels: doc_id, quality; null doc_id or quality is ignored, and of labels that repeat a doc_id the highest counts. Rows that
    repeat score alike. An empty table gives no rows; other columns are ignored.
    """
    net = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                x, counts = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                score = sent.value.score(x, counts) if sent.value else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score, pa.float64()), pa.array(counts.astype(np.int64))], ["doc_id", "score", "n_passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_passages long")
    return rows.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")
