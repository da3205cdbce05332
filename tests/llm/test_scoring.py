"""Toxicity, quality, decontamination, HTML and the pipeline: planted cases, held-out accuracy, hard rows."""

import time

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, html_extract, labelled as labelling, quality_mil, toxicity
from codeloom.llm.common import utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [(None, None), (1, ""), (2, " \n"), (3, "word " * 40_000), (4, "same"), (4, "same"), (5, "!!! $$$ 1234"), (6, "日本 é")]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in HARD], SCHEMA).select("*", F.lit(1).alias("label"), F.lit(2.0).alias("score"), F.lit("x").alias("id"), F.lit(0).alias("bad"), F.lit(b"").alias("row_key"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, n):
    return [str(w) for w in rng.choice(["the", "river", "stone", "under", "light", "morning", "paper", "garden", "quiet", "window", "letter", "travel"], n)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng, docs, labels = np.random.default_rng(1), [], []
    disguise = ["idiot", "1d10t", "i d i o t", "idioooot", "scum", "$cum", "s.c.u.m"]
    for i in range(900):
        words, toxic, junk = prose(rng, int(rng.integers(20, 200))), int(i % 5 == 0), int(i % 4 == 0)
        if toxic:
            words.insert(int(rng.integers(0, len(words))), ["idiot", "scum"][i % 2] if i < 600 else disguise[i % 7])
        docs.append((i, ("!! ".join(words).upper() if junk else " ".join(words)), "en", "s", 0))
        labels.append((i, 1 - junk, toxic))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in rows if r.held_out]
    assert 0.2 * len(rows) < len(held) < 0.45 * len(rows)
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def test_toxicity(labelled, hard, empty):
    docs, labels = labelled
    rows = toxicity.toxicity(docs, labels).collect()
    assert accuracy(rows, labels, "toxic") > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len(toxicity.toxicity(hard, labels).collect()) == len(HARD)
    assert {r.score for r in toxicity.toxicity(hard, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(empty, labels).isEmpty()
    kept = toxicity.filter_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


@pytest.mark.parametrize("said,meant", [("1d10t", "idiot"), ("idiooooot", "idiot"), ("m-o-r-o-n", "moron"), ("$cum", "scum"), ("tr@sh", "trash"), ("plain", "plain"), ("letter", "letter")])
def test_restore(spark, said, meant):
    words = ["idiot", "moron", "scum", "trash", "plain", "letter", "stone", "garden", "trust", "motion"] * 50
    channel = toxicity.Channel(toxicity.trigram_counts(spark.createDataFrame([(" ".join(words),)], "text string")))
    assert channel.restore(said) == meant
    assert "idiot" in channel.pieces("you i d i o t there")


@pytest.mark.parametrize("said,meant", [("idiiot", "idiot"), ("stuupid", "stupid"), ("scuum", "scum"), ("letter", "letter")])
def test_restore_of_one_doubling(spark, said, meant):
    words = ["idiot", "moron", "scum", "stupid", "plain", "letter", "stone", "garden", "trust", "motion"] * 50
    channel = toxicity.Channel(toxicity.trigram_counts(spark.createDataFrame([(" ".join(words),)], "text string")))
    assert channel.restore(said) == meant and meant in channel.pieces(f"you {said} there")


def test_spaced_words(spark):
    words = ["idiot", "moron", "scum", "stupid", "loser", "ass", "plain", "letter", "stone", "garden", "trust", "are", "you", "the", "a"] * 50
    channel = toxicity.Channel(toxicity.trigram_counts(spark.createDataFrame([(" ".join(words),)], "text string")))
    for said, meant in (("stu pid", "stupid"), ("lo ser", "loser"), ("s cum", "scum"), ("a s s", "ass"), ("stup id", "stupid")):
        assert meant in channel.pieces(f"garden {said} letter")
    said = " ".join("".join(["you", "are", "stupid", "moron", "plain"] * 8))
    assert channel.restore(said).split() == ["you", "are", "stupid", "moron", "plain"] * 8
    assert channel.restore("s-t-u-p-i-d" + "-" * 60) == "stupid"


def test_no_sign_is_lost_before_the_lattice(spark):
    words = ["idiot", "clown", "loser", "scum", "stupid", "plain", "letter", "stone", "garden", "trust", "are", "you", "the", "person", "there"] * 50
    channel = toxicity.Channel(toxicity.trigram_counts(spark.createDataFrame([(" ".join(words),)], "text string")))
    for said, meant in (("lo$$$er", "loser"), ("$$$cum", "scum"), ("(lown", "clown"), ("((lown)", "clown"), ("stupi d", "stupid"), ("s tupid", "stupid"), ("stup-- -id", "stupid"), ("st---up---id", "stupid"), ("!d!ot", "idiot")):
        assert meant in channel.pieces(f"you {said} person"), said
    assert {"you", "there"} <= channel.pieces("you...there (there)") and "there" in channel.pieces("(there")


def test_quality(labelled, hard, empty):
    docs, labels = labelled
    rows = quality_mil.quality(docs, labels).collect()
    assert accuracy(rows, labels, "quality") > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert len(quality_mil.quality(hard, labels).collect()) == len(HARD)
    assert {r.score for r in quality_mil.quality(hard, labels.limit(0)).collect()} == {0.5}
    assert quality_mil.quality(empty, labels).isEmpty()


def test_gradient():
    rng = np.random.default_rng(4)
    net = quality_mil.Attention(0, 1, {k: rng.normal(0, 0.5, s) for k, s in quality_mil.Attention.SHAPES.items()})
    x, counts, label = rng.normal(0, 1, (9, quality_mil.WIDTH)), np.array([2, 4, 3]), np.array([1.0, 0, 1])

    def loss():
        p = net.forward(x, counts)["score"]
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    g = net.gradient(x, counts, label)
    for k in g:
        at = tuple(0 for _ in np.shape(net.p[k]))
        old = np.array(net.p[k], float)
        up, down = old.copy(), old.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        net.p[k] = up
        a = loss()
        net.p[k] = down
        b = loss()
        net.p[k] = old
        assert abs((a - b) / 2e-5 - np.asarray(g[k])[at]) < 1e-6


ITEM = "When the harbour lights went out, nobody on the quay could tell whether the ferry had turned back or simply vanished into the rain. The captain later said otherwise."


@pytest.fixture(scope="module")
def channel():
    """A channel of random costs, which no two paths share."""
    return toxicity.Channel.of_costs(np.random.default_rng(31).uniform(0.2, 6, (toxicity.KINDS,) * 3))


def test_lattice_against_all_paths(channel):
    rng = np.random.default_rng(32)
    for _ in range(400):
        said = "".join(rng.choice(list("aabi1$0.-s !é"), int(rng.integers(1, 9))))
        said = " ".join(said.split()) or "a"
        paths = brute.cheapest(said, channel.cost, toxicity.LOOKALIKES, toxicity, toxicity.kind_of)
        assert channel.restore(said) in {x for cost, x in paths if cost < paths[0][0] + 1e-9}, said


def test_lattice_is_cut_where_it_may(channel):
    """Runs of short tokens that are decoded in parts give what they give in one piece."""
    rng, short = np.random.default_rng(33), ["ab", "ba", "a", "la", "al", "os,", "so", "no.", "1s", "tee", "$a", "é", "eta", "in", "-al-", "b--"]
    for _ in range(400):
        run = list(rng.choice(short, int(rng.integers(2, 7))))
        whole = set(channel.restore(" ".join(run)).split()) | {x for t in run for x in channel.pieces(t)}
        assert channel.pieces(" ".join(run)) == whole, run


def test_long_disguise(channel):
    """A disguise across any place of a long piece or of many spaced letters is decoded as one word."""
    rng = np.random.default_rng(34)
    counts = np.zeros((toxicity.KINDS,) * 3)
    codes = toxicity.kind(np.frombuffer((" " + " ".join(["idiot", *prose(rng, 2000), *["idiot"] * 50]) + " ").encode("utf-32-le"), np.uint32))
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    own = toxicity.Channel(counts)
    for n in (3, 44, 46, 47, 200):
        assert own.restore("x" * n + "1d10t").endswith("idiot")
        assert "idiot" in own.pieces(" ".join("stone" * n + "idiot" + "river"))


def test_signs_decoded_apart_give_the_whole_lattice():
    rng = np.random.default_rng(11)
    counts = np.zeros((toxicity.KINDS,) * 3)
    codes = toxicity.kind(np.frombuffer((" " + " ".join([*prose(rng, 2000), *["idiot", "stupid", "loser", "letter"] * 50]) + " ").encode("utf-32-le"), np.uint32))
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    own = toxicity.Channel(counts)
    for _ in range(20_000):
        token = "".join(rng.choice(list("stupidloser$0(4-.!²é1"), rng.integers(1, 16)))
        assert own._restored(token) == own._viterbi(token), token


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 5, f"t{i}") for i in range(2000)] + [(None, "n"), (6, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(None, 1), (3, 7), (1, 0)], "doc_id long, toxic int")
    rows = labelling.training_sample(docs, labels, "toxic", 3, 5, 4).collect()
    assert len(rows) <= 4 and len({r.text for r in rows}) == len(rows)
    assert sorted(map(str, rows)) == sorted(map(str, labelling.training_sample(docs.repartition(3), labels, "toxic", 3, 5, 4).collect()))


def edits(text, n, rng):
    chars = list(text)
    for at in sorted(rng.choice(len(chars), n, replace=False))[::-1]:
        kind = rng.integers(0, 3)
        chars[at : at + 1] = [] if kind == 0 else ["q"] if kind == 1 else [chars[at], "z"]
    return "".join(chars)


def test_decontamination(spark, hard, empty):
    rng = np.random.default_rng(6)
    clean = [" ".join(prose(rng, 300)) for _ in range(40)]
    cases = {100: clean[0] + " " + ITEM + " " + clean[1], 101: ITEM.upper().replace(" ", " \n"), 102: clean[2] + edits(ITEM, 3, rng), 103: clean[3] + ITEM[30:135], 104: clean[4] + ITEM[:60] + clean[5], 105: "so. " + ITEM.replace(",", ";"), 106: clean[6] + " zq  xv, " + clean[7], 107: clean[6] + " zq  xvs, " + clean[7]}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in [*enumerate(clean), *cases.items()]], SCHEMA)
    benchmark = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (None, ITEM), (9, "Zq, Xv!"), (11, " - "), (10, "another item of forty characters or so, yes")], "item_id long, text string")
    rows = decontaminate.contaminated(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in rows) == [*((i, x) for i in (100, 101, 102, 103, 105) for x in (0, 7)), (106, 9)]
    short = next(r for r in rows if r.doc_id == 106)
    assert cases[106].encode()[short.start : short.end] == b"zq  xv" and (short.edits, short.n_segments) == (0, 1)
    one = next(r for r in rows if r.doc_id == 100 and r.item_id == 7)
    assert one.edits == 0 and cases[100].encode()[one.start : one.end].decode().strip(" .") == ITEM.strip(".")
    left = decontaminate.decontaminate(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {*range(40), 104, 107}
    assert decontaminate.contaminated(hard, benchmark).isEmpty() and decontaminate.decontaminate(hard, benchmark).count() == len(HARD)
    assert decontaminate.contaminated(empty, benchmark).isEmpty() and decontaminate.contaminated(docs, benchmark.limit(0)).isEmpty()


def test_decontamination_in_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 100)
    rng = np.random.default_rng(8)
    items = [" ".join(prose(rng, 25)) for _ in range(6)]
    docs = spark.createDataFrame([(i, "x " + t) for i, t in enumerate(items)], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(6)}


def test_lemma_misses_nothing():
    """Every part within the edit budget of a segment is found: brute force over random edits."""
    rng = np.random.default_rng(12)
    segment = "".join(map(chr, rng.integers(97, 123, decontaminate.Bounds().segment)))
    index = decontaminate.Index.of([(0, segment)], decontaminate.Bounds())
    for _ in range(60):
        text = "".join(map(chr, rng.integers(97, 123, 50))) + edits(segment, int(index.edits[0]), rng) + "".join(map(chr, rng.integers(97, 123, 50)))
        assert decontaminate.find(index, *utf8(pa.array([text])))
        far = edits(segment, 30, rng)
        assert not decontaminate.find(index, *utf8(pa.array([far])))


def test_decontamination_by_rows(spark):
    """A null or repeated doc_id, and columns with the plan's names, play no part."""
    docs = spark.createDataFrame([(None, "x " + ITEM), (None, "clean text"), (5, "clean"), (5, ITEM + " y"), (5, "clean")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("__bad", "__gone", "row", "digest", "item_id")})
    left = decontaminate.decontaminate(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == ["clean", "clean", "clean text"]


def test_decontamination_against_alignment(spark):
    """Rows, edits and segments against a plain alignment of every segment with every text."""
    rng = np.random.default_rng(21)
    bounds = decontaminate.Bounds(40, 13, 10)
    items = [(i, " ".join(prose(rng, 14))) for i in range(4)] + [(4, "Odd, forty-odd: bytes & more!")]
    texts = [" ".join(prose(rng, 12)) + " " + edits(items[i % 5][1][int(rng.integers(0, 9)) :], int(rng.integers(0, 7)), rng) + " " + " ".join(prose(rng, 3)) for i in range(40)]
    found = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), bounds).collect()
    want = brute.contaminated(list(enumerate(texts)), items, bounds, decontaminate.Q)
    assert {(r.doc_id, r.item_id): (r.edits, r.n_segments) for r in found} == want and len(want) > 15


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<div id="cookie-notice"><p>We use cookies, many of them, to make this site better for all of you, as one does.</p></div>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav>
%s<aside class="sidebar"><p>Other stories, and more, and yet more of them.</p></aside>
<div class="comments"><p>First! I think, as ever, that this is wrong, and long, and so on.</p></div>
<form><p>Subscribe, please, it is free, and good.</p></form><script>var p = "<p>no</p>";</script><footer><p>&copy; us, them, all</p></footer></body></html>"""


@pytest.mark.parametrize("body,text", [
    ("<article><h1>Head</h1><p>One &amp; two,\n  three.<p>Four <b>five</b><br>six &#233;</p><div class=ad>Buy</div></article>", "Head\n\nOne & two, three.\n\nFour five six é"),
    ("<div class='content'><h2>Head</h2><p>A long paragraph, with commas, and words enough to matter.</p><p>Another, also long, for good measure and more.</p></div>", "Head\n\nA long paragraph, with commas, and words enough to matter.\n\nAnother, also long, for good measure and more."),
    ("<div><h2>Head</h2><p>A long paragraph, with commas, and words enough to matter.</p><ul><li>x<li>y</ul></div>", "Head\n\nA long paragraph, with commas, and words enough to matter.\n\nx\n\ny"),
    ("<article><p><b>Never closed.<br><p>Next, and last.</p></article>", "Never closed.\n\nNext, and last."),
    ("<article><p>One <button>Share <b>now</b></button>two <svg><text>no</text></svg>three.</p><section class='user-comments post'><p>First, I say, and long.</p></section><div class='entry-header'>Head</div></article>", "One two three.\n\nHead"),
    ("<article><p>A text, with some words in it, and a <a href=x>link</a>.</p><ul><li><a href=a>Read this too</a><li><a href=b>And this</a></ul><ul><li>A point, <a href=c>linked</a> a bit.</ul></article>", "A text, with some words in it, and a link.\n\nA point, linked a bit."),
    ("<article><p>Pick <select><option>a<option>b</select>one, or two.</p></p>Loose text</article>", "Pick one, or two.\n\nLoose text"),
])
def test_html(body, text):
    assert html_extract.main_text(PAGE % body) == text


def test_html_deep():
    """Time is linear in nested blocks that hold text, and in end tags that end nothing."""
    began = time.process_time()
    assert html_extract.main_text("<div><p>some text, here</p>" * 50_000).count("\n\n") == 49_999
    assert html_extract.main_text("<article>" + "<div>" * 50_000 + "deep" + "</section>" * 50_000 + "</article>") == "deep"
    assert time.process_time() - began < 40


def test_html_rows(spark):
    pages = [(1, "u", None), (2, None, ""), (None, "v", "<p>Just this.</p>"), (4, "w", "no tags &lt;b&gt;"), (4, "w", "no tags &lt;b&gt;"), (5, "x", "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "y", "<p>long</p>" * 20_000), (7, "z", "<!-- a --><![CDATA[x]]><p")]
    rows = html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(3))).collect()
    got = [(r.page_id, r.text) for r in rows]
    assert got[:5] == [(1, ""), (2, ""), (None, "Just this."), (4, "no tags <b>"), (4, "no tags <b>")] and got[5] == (5, "deep") and rows[6].n_chars == 20_000 * 6 - 2
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_pipeline(spark, tmp_path, labelled):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    docs, labels = labelled
    near = " ".join(prose(rng, 200))
    more = [(2000, near, "en", "s", 0), (2001, near + " again", "en", "s", 0), (2002, near + " once more", "en", "t", 0), (2003, " ".join(prose(rng, 100)) + " " + ITEM, "en", None, 0), (2004, None, None, None, None)]
    docs.unionByName(spark.createDataFrame(more, SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, left = left, stage(spark, left, str(tmp_path)).cache()
        seen[name] = {r.doc_id for r in left.collect()}
        assert name == corpus_pipeline.STAGES[-1][0] or left.columns == before.columns
    assert not {i for i in seen["toxicity"] if i < 600 and i % 5 == 0} and len(seen["toxicity"]) > 700
    assert {2000, 2004} <= seen["ngram_jaccard_join"] and not {2001, 2002} & seen["ngram_jaccard_join"]
    assert 2003 in seen["ngram_jaccard_join"] and 2003 not in seen["benchmark_decontamination"]
    assert seen["token_files"] == seen["mixing"]
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, left.collect()))
