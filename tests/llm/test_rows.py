"""Mixing, exact and near duplicates, token files, repeats and licenses against plain versions, on hard rows."""

import hashlib
import re
import zlib
from functools import partial

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import bwt_dedup, exact_dedup, licenses, mixing, ngram_join, queries, token_store
from codeloom.llm.common import Scratch, table
from codeloom.llm.components import components

LONG = " ".join(f"w{i}" for i in range(30_000))
BASE = [f"t{i}" for i in range(60)]


def near(*changed):
    return " ".join("x" if i in changed else w for i, w in enumerate(BASE))


TEXTS = [None, "", " \t\n", "one", "ONE", "one two", "on e", LONG, LONG + " end", near(), near(), near(3), near(3, 40), near(10, 20, 30, 40, 50), "".join(BASE), "é ü don't 日本 <|endoftext|> A1", "a " * 500, "b" * 450, "b" * 199 + "é", near(59) + "\x0b\x0c"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "size long, target double, digest string, cls binary, copies long, row string, part int, part2 int, `__x` int, k int, needed long, sid string, gone int, bad int"


def rows():
    """Texts with nulls, ties and repeated rows."""
    out = [(i, t, None, None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(TEXTS)]
    return [*out, out[11], (None, near(), "en", "s1", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [F.lit(None).cast(c.split()[1]).alias(c.split()[0].strip("`")) for c in CLASH.split(", ")]
    return spark.createDataFrame(rows(), SCHEMA).select("*", *extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return len(brute.WORDS.findall(t or ""))


def test_mixing(docs, empty, spark):
    got = mixing.mix_plan(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, words(t)) for i, t, *_ in rows())
    total, by = sum(r.size for r in got), {r.source: r for r in got}
    assert abs(sum(r.target for r in by.values()) - total) < 1e-6 * total
    free = [r.target / w for r, w in zip([by.get("s0"), by.get("s1"), by.get("s2"), by.get(None)], (5, 2, 1, 5)) if r and r.target < 3 * r.source_size]
    assert all(abs(x - free[0]) < 1e-6 * x for x in free)
    assert all(0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in got)
    for s, r in by.items():
        assert abs(sum(x.taken for x in got if x.source == s) - r.target) <= max(x.size for x in got if x.source == s)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(docs.repartition(3)).collect()))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and sum(words(r.text) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mix_plan(empty).isEmpty() and mixing.mix(empty).isEmpty()


def test_mixing_many_blocks(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 97 as int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    got = mixing.mix_plan(docs, block=64).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert all(abs(r.taken - r.target) < 0.02 * r.target for r in got)
    drawn = mixing.mix_plan(docs, block=64).groupBy("source").agg(F.sum("copies").alias("c"), (F.first("target") / F.first("source_size") * F.count("*")).alias("e")).collect()
    assert all(abs(r.c - r.e) <= 1.001 for r in drawn)  # systematic: expected copies, up to one


def test_exact(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in rows():
        groups.setdefault(plain(t), []).append((-len(t or ""), i if i is not None else -(1 << 63), i))
    assert len(got) == len(rows())
    for r in got:
        own = next(g for g in groups.values() if any(x[2] == r.doc_id for x in g) and hashlib.sha256(plain(dict((i, t) for i, t, *_ in rows())[r.doc_id]).encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (min(own)[2], len(own))
        assert not r.kept or r.doc_id == r.keep_id
    # one row of each group, also of rows that repeat
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted({r.text_sha256 for r in got})
    assert exact_dedup.exact_dedup(empty).isEmpty()


def test_exact_order(spark):
    """The least and greatest ids, null, and rows that repeat whole."""
    least, most = -(1 << 63), (1 << 63) - 1
    docs = spark.createDataFrame([(least, "a b"), (most, "a b"), (least, "ab"), (None, "zz"), (None, "zz"), (3, "zz"), (None, None), (None, "")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r)[:4] for r in exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect())))
    assert got == sorted(map(str, [(least, least, 3, True), (most, least, 3, False), (least, least, 3, False), (None, None, 3, True), (None, None, 3, False), (3, None, 3, False), (None, None, 2, True), (None, None, 2, False)]))


def test_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 100, 30_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        f = exact_dedup.FuseFilter.from_bytes(exact_dedup.FuseFilter.build(keys).to_bytes())
        assert f.holds(keys).all()
        assert f.holds(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 1e-3


def test_screen_and_bytes(spark, monkeypatch):
    """A filter that passes everything, and digests that collide, change nothing."""
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(["a", "b", "a ", "c", "b", "a"] * 3)], SCHEMA)
    want = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    monkeypatch.setattr(exact_dedup, "screen", lambda batch, filters, shards: batch.select("digest").distinct())
    assert sorted(map(str, exact_dedup.exact_dedup(docs).collect())) == want


def test_near(docs, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect()}
    want = brute.similar_components([(i if i is not None else -1, t) for i, t, *_ in rows()])
    # a null doc_id is the least; it stands for itself
    fix = lambda i: None if i == -1 else i
    assert got == {(fix(i), n, fix(c)) for i, (n, c) in want.items()}
    assert ngram_join.similar_components(empty).isEmpty() and ngram_join.keep_one(empty).isEmpty()
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {fix(i) for i, (_, c) in want.items() if c == i}


def test_near_families(spark):
    """Chains and families around the threshold, of all sizes, against all pairs."""
    rng, texts = np.random.default_rng(7), []
    for size in (6, 7, 8, 9, 12, 15, 20, 30, 45, 80, 150, 400):
        base = rng.integers(0, 500, size)
        for _ in range(9):
            t = base.copy()
            for _ in range(int(rng.integers(0, max(2, size // 12)))):
                t[rng.integers(0, size)] = rng.integers(500, 900)
            texts.append(" ".join(map(str, t[: size - int(rng.integers(0, max(1, size // 6)))])))
    docs = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.similar_components(docs)


def test_near_hub(spark, monkeypatch):
    """Copies that are like their original and not like one another, over many blocks, with and without the original."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng, docs = np.random.default_rng(11), []
    for family in range(2):
        base = [f"f{family}w{i}" for i in range(200)]
        for copy in range(50):
            words = list(base)
            for at in rng.choice(200, 4 if copy else 0 if family else 1, replace=False):
                words[at] = f"c{family}x{copy}y{at}"
            docs.append((len(docs), " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.similar_components(docs) and sum(c == 50 for _, c in got.values()) == 50


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 12), st.integers(0, 12), st.integers(0, 1 << 30))
def test_signatures_are_shared(common, left, right, seed):
    """Any two sets that are similar enough share a signature."""
    rng = np.random.default_rng(seed)
    values = np.unique(rng.integers(0, 1 << 63, common + left + right, dtype=np.uint64))
    rng.shuffle(values)
    a, b = np.sort(values[: common + left]), np.sort(np.concatenate((values[:common], values[common + left :])))
    if 4 * common >= 3 * len(values) and left + right:
        bands = ngram_join.Bands(75, 100)
        assert set(ngram_join.signatures(a, np.array([len(a)]), bands)[0]) & set(ngram_join.signatures(b, np.array([len(b)]), bands)[0])


def test_sketch_bound():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200), dtype=np.uint64)) for _ in range(2))
        x, y = (np.frombuffer(ngram_join.sketches(s, np.array([len(s)]))[0], np.uint64) for s in (a, b))
        while len(x) != len(y):
            x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(50, 60), (60, 55), (7, 7)], "a int, b int")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, **{i: 21 for i in range(22, 41)}, 60: 50, 55: 50}
    assert components(links.where("a < 0")).isEmpty()


def test_tokens(docs, empty, spark, tmp_path):
    config = queries.tokenizer_config()
    path = f"file://{tmp_path}/tokens"
    got = token_store.token_digest(docs, config, path=path).orderBy("start").collect()
    tokenizer = token_store.Encoder.of(config).tokenizer
    want, start = [], 0
    encoded = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in rows()]
    for i, ids in sorted(encoded, key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert list(map(tuple, got)) == want
    for i, ids in encoded:
        if i is not None:
            assert token_store.token_ids(spark, path, i).tolist() == ids
    assert token_store.token_ids(spark, path, 11, 1).tolist() == dict(encoded)[11] and token_store.token_ids(spark, path, 11, 2) is None and token_store.token_ids(spark, path, 12_345) is None
    assert token_store.token_digest(empty, config).isEmpty()


def test_tokens_many_shards(spark, tmp_path, monkeypatch):
    config = queries.tokenizer_config()
    docs = spark.range(1500).selectExpr("(id * 7919) % 1500 AS doc_id", "concat('word', id % 13, ' x', id) AS text")
    monkeypatch.setattr(token_store, "BLOCK_DOCS", 50)
    got = token_store.token_digest(docs, config).orderBy("doc_id").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == list(range(1500))


def test_tokens_of_one_doc_id_fill_several_shards(spark, tmp_path, monkeypatch):
    """A doc_id, or none, that holds most rows is dealt over shards, and each of its rows has its own key."""
    config, path = queries.tokenizer_config(), f"file://{tmp_path}/tokens"
    monkeypatch.setattr(token_store, "write_tokens", partial(token_store.write_tokens, shard_rows=200))
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "concat('word', id % 13, ' x', id) AS text").unionByName(spark.sql("SELECT CAST(7 AS BIGINT) AS doc_id, 'twice' AS text UNION ALL SELECT 7, 'twice'"))
    got = token_store.token_digest(docs, config, path=path).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and len(got) == 3002
    encoder = token_store.Encoder.of(config)
    crcs = sorted(zlib.crc32(np.array([*np.frombuffer(x, encoder.kind), 1], "<u4").tobytes()) for x in encoder.ids([r.text for r in docs.collect()]))
    assert sorted(r.ids_crc32 for r in got) == crcs
    rows = token_store.read_tokens(spark, path)
    counts = {r.doc_id: (r.shards, r.n, r.keys, r.most) for r in rows.where("doc_id IS NULL OR doc_id = 7").groupBy("doc_id").agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("n"), F.countDistinct("nth").alias("keys"), F.max("nth").alias("most")).collect()}
    assert all(shards > 1 and n == keys == most + 1 for shards, n, keys, most in counts.values()) and counts[None][1] == 1000 and counts[7][1] == 1002
    for r in rows.where("(doc_id IS NULL OR doc_id = 7) AND nth IN (0, 400, 999)").collect():
        assert token_store.token_ids(spark, path, r.doc_id, r.nth).tobytes() == bytes(r.ids)
    assert token_store.token_ids(spark, path, None, 1000) is None and token_store.token_ids(spark, path, 7, 1002) is None


def test_pieces_are_exact():
    encoder = token_store.Encoder.of(queries.tokenizer_config())
    rng = np.random.default_rng(5)
    alphabet = list("aé'sT1$ _ß \x85\x1cÀ́ <|>") + ["<|endoftext|>", "'ll", "日"]
    texts = ["".join(rng.choice(alphabet, 30)) for _ in range(400)] + [f"ab{chr(i)}cd {chr(i)}" for i in range(1, 0x800)]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.ids(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1), max_size=300))
def test_perfect_hash(ids):
    keys = token_store.key64(np.array(sorted(ids), np.int64), np.zeros(len(ids), np.int64))
    f = token_store.PerfectHash.from_bytes(token_store.PerfectHash.build(keys).to_bytes())
    assert sorted(f.numbers(keys).tolist()) == list(range(len(ids)))


def test_repeats(docs, empty):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.repeat_digest(docs).collect()))
    keyed = {n: (i, t) for n, (i, t, *_) in enumerate(rows())}
    plain = brute.repeated_bytes([(n, t) for n, (_, t) in keyed.items()])
    want = sorted((i is None, i or 0, *plain[n][:3], hashlib.sha256(plain[n][3]).hexdigest()) for n, (i, _) in keyed.items())
    assert got == want
    assert bwt_dedup.repeat_digest(empty).isEmpty()


def test_repeats_hot(spark, monkeypatch):
    """A passage in many rows at odd places, by the merge and by the count of a hot value."""
    rng = np.random.default_rng(2)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = noise(300)
    docs = [(i, noise(int(rng.integers(0, 300))) + passage[: 300 - i] + noise(50)) for i in range(60)] + [(60, "ab" * 400), (61, noise(900))]
    plain = brute.repeated_bytes(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for hot in (8 << 20, 2000):
        monkeypatch.setattr(bwt_dedup, "HOT_BYTES", hot)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.repeat_digest(frame).collect()}
        assert got == {i: (*p[:3], hashlib.sha256(p[3]).hexdigest()) for i, p in plain.items()}


def test_prefix_groups():
    rng = np.random.default_rng(9)
    for _ in range(20):
        texts = [rng.integers(1, 4, rng.integers(0, 25)) for _ in range(30)]
        group = bwt_dedup.prefix_groups(texts, 5, 40)
        keys = [tuple(t[i : i + 5]) if i + 5 <= len(t) else None for t in texts for i in range(len(t))]
        for k, g in zip(keys, group):
            assert (g >= 0) == (k is not None and keys.count(k) > 1)
        assert len({(k, g) for k, g in zip(keys, group) if g >= 0}) == len({g for g in group if g >= 0})


def test_licenses(spark, docs, empty):
    known = licenses.known_digests(spark)
    mit = licenses.KNOWN[0][1]
    bodies = ["Copyright (c) 2020 A. Writer\n\n" + mit.upper().replace(" ", "  \n"), mit.replace("License", "Licence"), "some prose\nReleased under the MIT licence!\r\nmore", mit + " and more", "All rights reserved.", None]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(bodies)], SCHEMA)
    got = {r.doc_id: (r.text_license, r.line_licenses, r.n_lines) for r in licenses.license_scan(frame, known).collect()}
    assert got[0][0] == "MIT" and got[1] == ("MIT", ["MIT"], 1) and got[2] == (None, ["MIT"], 1) and got[3] == got[4] == got[5] == (None, [], 0)
    out = licenses.license_scan(docs, known).collect()
    assert len(out) == len(rows()) and {r.text_digest for r in out if r.doc_id in (0, 1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert licenses.license_scan(empty, known).isEmpty()
    plan = licenses.license_scan(docs, known)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences_by_row(spark):
    """Rows that share a doc_id, or have none, keep their own lines."""
    docs = spark.createDataFrame([(5, "Licensed under the MIT License."), (5, "other words"), (None, "Licensed under the MIT License."), (None, "x")], "doc_id long, text string")
    got = licenses.license_scan(docs, licenses.known_digests(spark)).collect()
    assert sorted((r.doc_id or 0, r.line_licenses, r.n_lines) for r in got) == [(0, [], 0), (0, ["MIT"], 1), (5, [], 0), (5, ["MIT"], 1)]


def test_other_tokenizers_encode_whole_texts(spark):
    """The fast way is for its own pattern alone."""
    config = queries.tokenizer_config()
    other = config.replace("[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+", "[^\\\\s]+")
    assert other != config and token_store.splits_at_space(config) and not token_store.splits_at_space(other)
    got = token_store.token_digest(spark.createDataFrame([(1, "abc123 x")], "doc_id long, text string"), other).first()
    want = [*token_store.Encoder.of(other).tokenizer.encode("abc123 x", add_special_tokens=False).ids, 1]
    assert (got.n_tokens, got.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))


def test_near_family_is_linear(spark):
    """A large family of copies, each changed on its own, gives links by the member, not by the pair; one row of it stays, also where rows repeat."""
    rng, base, docs = np.random.default_rng(13), [f"w{i}" for i in range(150)], []
    for copy in range(1200):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 8)), replace=False):
            words[at] = f"c{copy}x{at}"
        docs.append((copy, " ".join(words)))
    frame = spark.createDataFrame([*docs, docs[0], docs[0]], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(frame).collect()}
    assert got == brute.similar_components(docs)
    sets, scratch = ngram_join.set_table(frame, 5).dropDuplicates(["cls"]).cache(), Scratch(spark, "test")
    groups = ngram_join.signature_groups(frame, 5, ngram_join.Bands(75, 100), 4)
    maybe = ngram_join.maybe_links(groups, sets, 75, 100)
    assert maybe.count() < 4 * len(docs)
    links = ngram_join.exact_links(sets.selectExpr("0L AS cluster", "cls", "doc_id", "digest", "n_shingles"), frame, 5, 75, 100, scratch)
    assert links.count() < len(docs)
    kept = ngram_join.keep_one(frame).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, c) in got.items() if c == i)


def test_licence_lines(spark):
    names = ["Licensed under CC BY-NC 4.0.", "Released under CC-BY-NC-ND 3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: AGPL-3.0", "Released under the LGPL v2.1", "Licensed under the Apache License, Version 2.0."]
    found = ["CC-BY-NC-4.0", "CC-BY-NC-ND-3.0", "CC-BY-NC-SA-4.0", "AGPL-3.0", "LGPL-2.1", "Apache-2.0"]
    texts = dict(licenses._whole_texts())
    frame = spark.createDataFrame([*enumerate(names), *[(100 + i, "Copyright (c) 2020 A. Writer\n" + texts[k]) for i, k in enumerate(licenses.TEXTS)]], "doc_id long, text string")
    known = licenses.known_digests(spark)
    got = {r.doc_id: (r.text_license, r.line_licenses) for r in licenses.license_scan(frame, known).collect()}
    assert [got[i][1] for i in range(len(names))] == [[x] for x in found]
    assert [got[100 + i][0] for i in range(len(texts))] == list(licenses.TEXTS)


def test_licence_lines_of_fixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", F.explode(F.split("text", "[\r\n]+")).alias("text"))
    naming = docs.where(F.length("text") < 200).where(F.col("text").rlike(r"(?i)\blicen[sc]e|\bCC[ -]BY|\bCC0\b|SPDX")).withColumn("doc_id", F.monotonically_increasing_id())
    naming = table(naming, "licence-lines")
    scanned = licenses.license_scan(naming, licenses.known_digests(spark)).cache()
    assert scanned.count() == 262 and scanned.where("n_lines = 0").isEmpty()
    assert scanned.where("text_license = 'CC-BY-NC-4.0'").count() == 63


def test_a_worker_keeps_what_one_operator_remembers():
    """A task of another operator lets go of a channel; one of the same operator finds it again. Each batch goes through."""
    import gc
    import weakref

    import pyarrow as pa

    from codeloom.llm import common, toxicity

    cost = np.ones(toxicity.KINDS**3)
    channel = weakref.ref(toxicity.Channel.of_costs(cost))
    batches = [pa.record_batch({"x": [1, 2]}), pa.record_batch({"x": [3]})]
    through = lambda given: (b.slice(0, 1) for b in given)
    assert [b.to_pylist() for b in common.tidy("toxicity", through)(iter(batches))] == [[{"x": 1}], [{"x": 3}]]
    assert toxicity.Channel.of_costs(cost) is channel()
    list(common.tidy("ngram_join", through)(iter(batches)))
    gc.collect()
    assert channel() is None
