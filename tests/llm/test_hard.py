"""Rows that once broke an operator: dotted names, long words, doc_ids that repeat, boxes inside an article."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, html_extract, mixing, ngram_join, quality_mil, toxicity


def test_columns_with_dots(spark):
    docs = spark.createDataFrame([(i, f"some plain words number {i}", "s", i, "x") for i in range(40)], "doc_id long, text string, source string, `a.b` long, `text.c` string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some plain words number 7")], "item_id long, text string")
    for out in (mixing.mix(docs), decontaminate.decontaminate(docs, bench), toxicity.filter_toxic(docs, labels), ngram_join.keep_one(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r["a.b"] == r.doc_id and r["text.c"] == "x" and r.text.endswith(str(r.doc_id)) for r in rows)


def test_quality_of_a_word_without_end(spark):
    """A labelled row that is one word of a megabyte leaves scores finite, and other rows apart."""
    good = "The river ran past the old mill, and the children watched it every day. " * 3
    bad = "$$$ !!! buy buy buy now now | | | " * 5
    rows = [(i, (good if i % 2 else bad) + f" n{i}") for i in range(200)] + [(1001, "w" * 1_000_000), (1002, "é" * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1001, 0), (1002, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_mil.quality(docs, labels).collect()}
    assert all(math.isfinite(s) and 0 <= s <= 1 for s in got.values())
    assert np.mean([got[i] for i in range(1, 200, 2)]) > 0.7 > 0.3 > np.mean([got[i] for i in range(0, 200, 2)])


def test_near_rows_of_one_doc_id(spark, monkeypatch):
    """Texts meet clusters by doc_id and text: of 5,000 rows without an id, in pairs, none meets another pair's cluster."""
    n, seen = 2500, []
    text = lambda i, last: " ".join(f"u{i}x{k}" for k in range(30)) + last
    docs = spark.createDataFrame([(None, text(i, last)) for i in range(n) for last in ("", " end")], "doc_id long, text string")
    plain = ngram_join.in_blocks

    def counted(rows, group, key, blocks):
        if group == "cluster":
            seen.append(rows.count())
        return plain(rows, group, key, blocks)

    monkeypatch.setattr(ngram_join, "in_blocks", counted)
    assert ngram_join.keep_one(docs).count() == n
    assert seen == [2 * n]


BOXES = ["main-menu", "content-sidebar", "entry-footer", "post-navigation", "story-notice", "text-widget", "content-newsletter", "post-related", "main-cookie-notice", "body-popup", "sidebar content-sidebar", "post-comments", "sidebar", "widget"]
STAY = ["post-header", "post with-sidebar", "content has-banner", "content sidebar-right", "entry-content", "story", "lead", "text no-menu"]
P = "<p>The council met on Monday, and after two hours of talk, it put the matter off until the spring.</p>"


@pytest.mark.parametrize("name", BOXES + STAY)
@pytest.mark.parametrize("page", ["<article>{0}{1}{0}</article>", "<main>{0}{1}{0}</main>", "<div class=content>{0}{0}{0}{1}</div>"])
def test_boxes_in_an_article(name, page):
    box = f'<div class="{name}"><p>What stands in the box, of some length.</p></div>'
    blocks = html_extract.main_blocks(f"<html><body>{page.format(P, box)}</body></html>")
    assert ("What stands in the box, of some length." in blocks) == (name in STAY) and sum(b.startswith("The council") for b in blocks) >= 2


def test_a_menu_outside_the_article_goes():
    html = f'<body><div class="main-menu"><p>Home, and other places, of this site.</p></div>{P * 3}<div class="page-footer">All rights, of course.</div></body>'
    assert len(html_extract.main_blocks(html)) == 3


def test_anchors_without_a_target_are_no_links():
    html = f"<main><div><a name=x>{P}{P}</div><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></main>"
    assert len(html_extract.main_blocks(html)) == 2
    # a link that is not ended ends with the element that it began in, or where the next one begins
    html = f"<main><div><a href=/x>Go</div>{P}{P}<p><a href=/y>Up<a name=z>, a plain word, and more of them here</p></main>"
    assert html_extract.main_blocks(html) == ["Go", *html_extract.main_blocks(P + P), "Up, a plain word, and more of them here"] or len(html_extract.main_blocks(html)) == 3


def test_plain_items_of_a_list_of_links_stay():
    links = "".join(f"<li><a href=/{i}>A linked headline number {i}</a></li>" for i in range(6))
    html = f"<article>{P}<ul>{links}<li>A plain item, which says something.</li></ul>{P}</article>"
    blocks = html_extract.main_blocks(html)
    assert "A plain item, which says something." in blocks and len(blocks) == 3


def plain_bands(pattern, text, k):
    """Whether a part of text is within k edits of pattern, and the least edits: every cell."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("item,text", [("ab " * 100, "ab " * 300), ("ab " * 30 + "x" + "ab " * 30, "ab " * 200), ("abc " * 40, "abc abd " * 60 + "abc " * 25), ("ab " * 100, "zz " * 50 + "ab " * 40 + "zz " * 50)])
def test_periodic_texts(item, text):
    """What is found in a periodic text is what a plain alignment of all segments finds."""
    bounds = decontaminate.Bounds()
    index = decontaminate.Index.of([(1, item)], bounds)
    raw = np.frombuffer(text.encode(), np.uint8)
    found = decontaminate.find(index, raw, np.array([0, len(raw)]))
    said = text.strip().encode()
    want = {s: e for s, t in enumerate(index.texts) if (e := plain_bands(t, said, int(index.edits[s]))) <= index.edits[s]}
    least = {}
    for _, s, a, z, e in found:
        least[s] = min(e, least.get(s, 99))
        assert 0 <= a < z <= len(raw)
    assert least == want
    segments = len(range(0, max(1, len(item.strip()) - 80 + 1), 20)) + (0 if (len(item.strip()) - 80) % 20 == 0 else 1)
    assert sum(index.copies) == segments and len(set(index.texts)) == len(index.texts)


def test_a_megabyte_that_repeats():
    """Work is linear in a periodic text, with an item of the same period and with one that is an edit away in each segment."""
    import time

    raw = np.frombuffer(("ab " * 350_000).encode(), np.uint8)
    for item in ("ab " * 100, "ab ab ab ab ab ab ab ab ab ab x " * 12):
        index = decontaminate.Index.of([(1, item)], decontaminate.Bounds())
        began = time.time()
        found = decontaminate.find(index, raw, np.array([0, len(raw)]))
        assert time.time() - began < 60
        if item.startswith("ab " * 50):
            assert min(a for _, _, a, _, _ in found) == 0 and max(z for _, _, _, z, _ in found) >= len(raw) - 3 and min(e for *_, e in found) == 0
