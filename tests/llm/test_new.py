"""Fingerprints, resampling and hard negatives against plain versions, on hard rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import fingerprints, hard_negatives, resampling
from codeloom.llm.common import Scratch

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", " \t\n", "one", "ONE", "one two", "on e", BASE, BASE, BASE + " end", BASE.replace("word3 ", "x "), "é ü don't 日本 <|x|> A1", "a " * 500, "b" * 450, "w" * 49 + " " + "w" * 48 + " q", " ".join(f"t{i % 97}" for i in range(3000)), "x1\x00y\x7fz~é~k"]
EXTRA = "key binary, part int, `a.b` int, word string, weights binary, words long, h1 long, nth int, block string"


def rows():
    return [*enumerate(TEXTS), (7, BASE), (None, BASE), (None, None), (-5, "minus five words are here now")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string").select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0].strip("`")) for c in EXTRA.split(", ")])


def plain_fingerprints(docs):
    """(doc_id, text) -> rows of the report without near_docs, in the order of documents."""
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w]
    h = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    held = Counter(h(w) & 0xFFFF for _, t in docs for w in set(words(t or "")))

    def mark(t):
        votes = np.zeros(128, np.int64)
        for w in set(words(t)):
            x = h(w)
            n = min(15, 1 + max(0, round(2 * math.log((len(docs) + 1) / max(1, held[x & 0xFFFF])))))
            bits = x | xxhash.xxh64_intdigest(struct.pack("<Q", x), 42) << 64
            votes += [n if bits >> k & 1 else -n for k in range(128)]
        on = [bool(v > 0) for v in votes]
        return "".join(f"{sum(1 << k for k in range(64) if on[64 * half + k]):016x}" for half in (0, 1))

    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), f"{xxhash.xxh64_intdigest((d[1] or '').encode(), 42):016x}"))
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        f, e = mark(t), mark(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, 1 - apart(f, e) / 128, 1 - apart(f, mark(after)) / 128))
    return out


def by_id(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1:4]))


def test_fingerprints(docs, spark):
    got = fingerprints.fingerprint_report(docs).collect()
    assert by_id(tuple(r)[:7] for r in got) == by_id(plain_fingerprints(rows()))
    prints = [int(r.fingerprint, 16) for r in got]
    for r in got:
        near = sum((int(r.fingerprint, 16) ^ f).bit_count() <= fingerprints.RADIUS for f in prints) - 1
        assert r.near_docs == (near if r.doc_id == 0 else None)
    assert fingerprints.fingerprint_report(docs.limit(0)).count() == 0
    one = fingerprints.fingerprint_report(docs.where("doc_id = 9")).first()
    text = TEXTS[9]
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256((text[: len(text) - len(text) // 2] + text[: len(text) // 2]).encode()).hexdigest()


@pytest.mark.parametrize("radius", [0, 3, 6, 9])
def test_near_fingerprints(spark, radius):
    """Permuted block tables find each pair within the radius once, and no other."""
    rng = np.random.default_rng(radius)
    base = [int.from_bytes(rng.bytes(16)) for _ in range(20)]
    marks = sorted({b ^ sum(1 << int(k) for k in rng.choice(128, int(rng.integers(0, 12)), False)) for b in base for _ in range(30)} | {0, (1 << 128) - 1})
    halves = lambda m: struct.unpack(">qq", m.to_bytes(16))
    held = spark.createDataFrame([halves(m) for m in marks], "f1 long, f2 long")
    asked = spark.createDataFrame([halves(m) for m in marks[::5]], "f1 long, f2 long")
    got = sorted(tuple(r) for r in fingerprints.near_fingerprints(held, asked, radius).collect())
    assert got == sorted((*halves(q), *halves(f), (q ^ f).bit_count()) for q in marks[::5] for f in marks if (q ^ f).bit_count() <= radius)


def counts(text, buckets=10_000):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1))


def plain_resample(docs, target):
    held = [(i, *counts(t)) for i, t in docs]
    s, t = sum((c for *_, c in held), Counter()), sum((counts(x)[1] for x in target), Counter())
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(s.total() + 10_000) / (float(s[b] + 1) * float(t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, c in held:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_resampling(docs, spark):
    more = [(i, f"{BASE} {' '.join(f'v{i * k % 41}' for k in range(i % 60))}") for i in range(100, 400)]
    more += [(100, more[0][1])] * 9  # rows that repeat, with equal scores
    all_docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    target = [None, "", "word1 word2 word3", " ".join(f"v{k}" for k in range(41))]
    asked = spark.createDataFrame([(t,) for t in target], "text string")
    got = by_id(tuple(r) for r in resampling.resample(all_docs, asked).collect())
    want = by_id(plain_resample([*rows(), *more], target))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted((r for r in got if r[4]), key=str) == sorted((r for r in want if r[4]), key=str)
    assert resampling.resample(docs.limit(0), asked).count() == 0
    alone = by_id(tuple(r) for r in resampling.resample(docs, asked.limit(0)).collect())
    assert alone == by_id(plain_resample(rows(), []))


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", 400)
    monkeypatch.setattr(resampling, "PIECE", 50)
    for text in ("ab c " * 300, "w" * 900, "x" * 70 + " " + "y" * 500 + " z", "é1 " * 400 + "last", " " * 500, "one " + " " * 500 + "two three"):
        raw = np.frombuffer(text.encode(), np.uint8)
        key, count, held, features = resampling._postings(raw, np.array([0, len(raw)]), 10_000)
        n, want = counts(text)
        assert dict(zip(key.tolist(), count.tolist())) == dict(want) and held[0] == n and features[0] == want.total()


def test_every_posting_is_shuffled_to_its_group(spark, docs, tmp_path):
    """Any number of groups and of parts of a group gives the same weights."""
    target = spark.createDataFrame([("word1 word2",)], "text string")
    one = sorted(tuple(r) for r in resampling.document_weights(docs.where("doc_id IS NOT NULL"), target, Scratch(spark, "t"), groups=1).collect())
    assert one == sorted(tuple(r) for r in resampling.document_weights(docs.where("doc_id IS NOT NULL"), target, Scratch(spark, "t"), groups=13).collect())


def plain_negatives(rows):
    """rows (vec_id, embedding, label), all of which take part."""
    held = [(i, [math.floor(256 * x) for x in v], (c + 1) % 10 if i is not None and i % 7 == 0 else c) for i, v, c in rows]
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (i, v, c) in enumerate(held):
        if i is None or i % 100:
            continue
        s = [(sum(a * b for a, b in zip(v, w)), j, d) for m, (j, w, d) in enumerate(held) if m != k]
        for p, j, _ in sorted((x for x in s if x[2] == c), key=lambda x: (-x[0], last(x[1])))[:5]:
            fit = sorted((x for x in s if x[2] != c and 30 * p <= 100 * x[0] <= 90 * p), key=lambda x: (-x[0], last(x[1])))[:10]
            out += [(i, j, n + 1, m, p, q) for n, (q, m, _) in enumerate(fit)]
    return sorted(out, key=str)


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    rows = [(int(i), [float(np.float32(x)) for x in centre[i % 6] + rng.normal(size=8) * 0.3], int(i % 3)) for i in range(700)]
    rows += [(int(i), rows[0][1], int(i % 2)) for i in range(700, 900)]  # one hot vector
    rows += [rows[3], rows[100], (100, rows[5][1], 1), (None, rows[6][1], 0), (1000, [], 2), (1001, [1.0, 2.0], 1), (1100, [0.0] * 8, 1), (1200, [3.0] * 11, 0)]
    out = [(300, None, 1), (301, rows[0][1], None), (400, [1.0, None], 1), (500, [math.nan] * 8, 1), (600, [math.inf] * 8, 0), (700, [-math.inf] + [0.0] * 7, 0)]
    table = spark.createDataFrame([*rows, *out], "vec_id long, embedding array<float>, label int").withColumns({"uid": F.lit(1), "score": F.lit("s"), "a.b": F.lit(1)})
    got = sorted((tuple(r) for r in hard_negatives.hard_negatives(table).collect()), key=str)
    assert got == plain_negatives(rows)
    assert hard_negatives.hard_negatives(table.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(table.where("vec_id = 100")).count() >= 0


def test_node_pairs_are_left_with_all_their_anchors():
    """Far nodes are never scored, and what is found is the same."""
    rng = np.random.default_rng(2)
    v = np.concatenate([np.floor(rng.normal(size=(512, 4)) * 5), np.floor(rng.normal(size=(512, 4)) * 5) + 500])
    block = lambda rows: {"n": len(rows), "width": 4, "uid": np.asarray(rows, np.int64).tobytes(), "vec_id": np.asarray(rows, np.int64).tobytes(), "label": np.zeros(len(rows), np.int64).tobytes(), "v": v[rows].tobytes(), "extra": None}
    found = hard_negatives.Search([block(np.arange(512, 1024, 8))], 5, True)
    scored = []
    leaves = found._leaves
    found._leaves = lambda a0, a1, s, *rest: (scored.append(s.size), leaves(a0, a1, s, *rest))
    found.meet(block(np.arange(512, 1024)))
    found.best()
    before = sum(scored)
    found.meet(block(np.arange(512)))
    assert sum(scored) == before == 64 * 512
    got = {(r["anchor_id"], r["vec_id"]) for r in found.results().to_pylist()}
    for a in range(512, 1024, 8):
        s = v @ v[a]
        assert {x for i, x in got if i == a} == set(sorted((x for x in range(1024) if x != a), key=lambda x: (-s[x], x))[:5])


def test_labels_that_no_anchor_wants_are_left():
    """Positives are looked for among rows of the anchor's label alone, negatives among the others; rows of any label may share a block."""
    rng = np.random.default_rng(3)
    v, label = np.floor(rng.normal(size=(4000, 16)) * 40), rng.integers(0, 4, 4000)
    extra = np.tile(np.array([[-1500, 900], [-2000, 400]], np.int64), (400, 1, 1))
    block = lambda rows, extra=None: {"n": len(rows), "width": 16, "uid": rows.tobytes(), "vec_id": rows.tobytes(), "label": label[rows].tobytes(), "v": v[rows].astype(np.int16).tobytes(), "extra": extra}
    anchors, rows, s = np.arange(0, 4000, 10), np.arange(4000), (v @ v.T).astype(int)
    for same in (True, False):
        found, scored = hard_negatives.Search([block(anchors, None if same else extra.tobytes())], 5, same), []
        leaves = found._leaves
        found._leaves = lambda a0, a1, x, *rest: (scored.append(x.size), leaves(a0, a1, x, *rest))  # noqa: B023
        found.meet(block(rows))
        alike = sum((label == label[a]).sum() for a in anchors)
        assert sum(scored) == (alike if same else 400 * 4000 - alike) and found.tree.v.dtype == np.float32
        got = {}
        for r in found.results().to_pylist():
            got.setdefault((r["anchor_id"], r["slot"]), []).append((-r["score"], r["vec_id"]))
        for a in anchors.tolist():
            for k, (low, high) in enumerate([(-(10**9), 10**9)] if same else extra[0].tolist()):
                fit = [(-s[a, x], x) for x in range(4000) if x != a and (label[x] == label[a]) == same and low <= s[a, x] <= high]
                assert got.get((a, k), []) == sorted(fit)[:5]


def test_scores_are_exact_in_each_kind_of_number():
    rng = np.random.default_rng(4)
    for most in (1 << 8, 1 << 12, 1 << 20, 1 << 28):
        a, c = rng.integers(-most, most, (20, 48)), rng.integers(-most, most, (30, 48))
        norm = lambda x: float(np.sqrt((x.astype(float) ** 2).sum(1)).max())
        got = hard_negatives.scores(a.astype(float), c.astype(float), norm(a) * norm(c))
        assert [[int(x) for x in row] for row in got] == [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in c] for x in a]


def test_hard_negatives_cells_follow_the_work(spark, monkeypatch):
    """Cells do not follow the number of shuffle partitions, each gives an anchor one row, and large components score as exactly as small ones."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * (1 if i % 3 else 3e5)], i % 2) for i in range(900)]
    table, cells, met = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), [], []
    search, merged = hard_negatives.search, hard_negatives.merged
    monkeypatch.setattr(hard_negatives, "BLOCK", 100)
    monkeypatch.setattr(hard_negatives, "search", lambda a, c, keep, same, chunks, parts: (cells.append(chunks * parts), search(a, c, keep, same, chunks, parts))[1])
    monkeypatch.setattr(hard_negatives, "merged", lambda m, keep: (met.append(m.count()), merged(m, keep))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert sorted((tuple(r) for r in hard_negatives.hard_negatives(table).collect()), key=str) == plain_negatives(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert cells == [9, 9] and all(n <= 9 * 9 for n in met)
