"""Main text of web pages: a tree of blocks, scored by its paragraphs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements without an end tag, elements that break a line of text, elements that a new block ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never part of an article; of these, the ones that stand within a line of text.
NEVER = frozenset("head title script style noscript template nav aside footer form button select option textarea input fieldset legend iframe object embed svg math canvas audio video dialog menu map".split())
INLINE = frozenset("button select option textarea input iframe object embed svg math canvas audio video map script style noscript template".split())
#: Containers that are left out of an article where most of their text is links.
LISTS = frozenset("ul ol dl div section table".split())
#: Words of class and id (whole tokens) and roles that mark what is not the article.
UNLIKELY = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus discussion footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Of these, the words that no other word outweighs.
COMMENTS = frozenset("ad ads advert adverts advertisement advertising banner comment comments commentlist disqus discussion replies reply respond sponsor sponsored".split())
LIKELY = frozenset("article body content entry main post story text".split())
#: What follows one of these in a name says how the element is laid out, not what it is: "post has-sidebar".
STATES = frozenset("has is no not show hide with without".split())
#: Containers of items: where most of their text is links, items that are mostly links go, and the others stay.
ITEMS = frozenset("ul ol dl table".split())
_TOKEN = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")


def named(names: str) -> tuple[bool, bool, bool]:
    """Whether names (of class and id) mark comments or adverts, other boilerplate, an article.

    Each name is judged by its words. An unlikely word makes it boilerplate, likely ones beside it or not ("main-menu"): these say where it stands; but the header
    of an entry is its head.
    """
    comments = unlikely = likely = False
    for name in names.split():
        words = []
        for w in _TOKEN.findall(name):
            if w in STATES:
                break
            words.append(w)
        good, bad = LIKELY.intersection(words), UNLIKELY.intersection(words)
        if bad & COMMENTS:
            comments = True
        elif bad and not (good and bad == {"header"}):
            unlikely = True
        elif good:
            likely = True
    return comments, unlikely, likely


class Node:
    """An element: what it holds counts in chars, linked and score; out marks boilerplate, inside what stands in an article or main element."""

    __slots__ = ("tag", "parent", "out", "inside", "bonus", "score", "chars", "linked", "order", "kept", "plain")

    def __init__(self, tag: str, parent: Node | None, out: bool, bonus: float, order: int):
        self.tag, self.parent, self.out, self.bonus, self.order = tag, parent, out, bonus, order
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.score = 0.0
        self.chars = self.linked = 0
        self.kept = self.plain = False


class Tree(HTMLParser):
    """The page's elements, and its blocks of text as (node, text, characters in links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node = Node("#root", None, False, 0, 0)
        self.nodes, self.blocks, self.parts, self.links, self.link = [self.node], [], [], 0, None
        self.open, self.mute = Counter(), []

    def flush(self):
        if self.parts:
            text = _WHITE.sub(" ", "".join(self.parts)).strip()
            if text and not self.node.out:
                self.blocks.append((self.node, text, min(self.links, len(text))))
            self.parts, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "a":
            # one with a target is a link, until the next one, its end or the end of the element that it began in
            self.link = self.node if any(k == "href" for k, _ in attrs) else None
            return
        if tag in INLINE:
            # what it holds is no text, and the line goes on after it
            if tag not in VOID:
                if tag == "option":
                    self.unmute("option", "select")
                self.mute.append(tag)
            return
        if tag not in BLOCK and tag not in NEVER:
            return
        if self.mute:
            if tag not in VOID:
                self.mute.append(tag)
            return
        self.flush()
        if tag in VOID:
            return
        if tag in BLOCK:
            self.leave("p", ("article", "aside", "body", "button", "div", "main", "nav", "section", "table", "td", "th"))
        if tag in ("li", "dd", "dt", "td", "th", "tr"):
            for same in ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,):
                self.leave(same, ("ul", "ol", "dl", "table", "tbody", "menu", *(("tr",) if tag in ("td", "th") else ())))
        said = {k: (v or "").lower() for k, v in attrs}
        comments, unlikely, likely = named(f"{said.get('class', '')} {said.get('id', '')}")
        out = self.node.out or tag in NEVER or (tag == "header" and not self.node.inside) or said.get("role") in ROLES or "hidden" in said or said.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said.get("style", "")))
        # of several names one that is the article's alone outweighs others ("content sidebar-right"), but for comments
        out = out or (tag not in ("html", "body", "article", "main") and (comments or (unlikely and not likely)))
        out = out or (tag == "article" and bool({"comment", "comments", "reply", "replies"}.intersection(_TOKEN.findall(f"{said.get('class', '')} {said.get('id', '')}"))))
        bonus = 25.0 * (tag in ("article", "main") or said.get("role") in ("main", "article")) + 10.0 * likely
        self.node = Node(tag, self.node, out, bonus, len(self.nodes))
        self.nodes.append(self.node)
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in NEVER:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def leave(self, tag: str, barriers: tuple[str, ...]):
        """End the innermost open element of that name, unless a barrier stands before it."""
        if not self.open[tag]:
            return
        node = self.node
        while node.parent is not None and node.tag != tag and node.tag not in barriers:
            node = node.parent
        if node.tag == tag and node.parent is not None:
            self.flush()
            while self.node is not node.parent:
                self.open[self.node.tag] -= 1
                if self.node is self.link:
                    self.link = None
                self.node = self.node.parent

    def unmute(self, tag: str, barrier: str = ""):
        """End the innermost open inline element of that name and what is open in it, unless a barrier stands before it."""
        for n in range(len(self.mute) - 1, -1, -1):
            if self.mute[n] == tag:
                del self.mute[n:]
                return
            if self.mute[n] == barrier:
                return

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        elif tag in INLINE:
            self.unmute(tag)
        elif (tag in BLOCK or tag in NEVER) and tag not in VOID:
            if tag in self.mute:
                self.unmute(tag)
                return
            if self.open[tag]:
                self.mute = []  # the end of a block ends what was left open in it
            elif self.mute:
                return
            self.flush()
            self.leave(tag, ("body", "html", "table") if tag in ("p", "li", "dd", "dt") else ())

    def handle_data(self, data):
        if self.mute:
            return
        self.parts.append(data)
        if self.link is not None:
            self.links += len(data)

    def unknown_decl(self, data):
        pass


def main_blocks(html: str) -> list[str]:
    """The blocks of the page's main text, in page order.

    Each block gives points to its element's parent, and half of them to the grandparent: one, one per comma, and up to three by
    length, less the share of its text in links; marked-up articles start with a bonus. The container with the most points (after
    its own link density) and siblings of it that earn a fifth, or that are plain paragraphs or headings, are the article. If it stands
    in an article or main element, that is the container, less divisions in it of which most is links, and the linked items of such lists. Of no container with
    points, all blocks outside boilerplate are kept. Every step is linear in the page, however deep its elements nest.
    """
    tree = Tree()
    tree.feed(html)
    tree.close()
    tree.flush()
    if not tree.blocks:
        return []
    for node, text, linked in tree.blocks:
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        share, up = 1.0, node.parent or node
        up.chars += len(text)
        up.linked += linked
        while up is not None and share >= 0.25:
            up.score += points * share
            share, up = share / 2, up.parent
    # elements are in the order in which they began, parents first
    for node in reversed(tree.nodes[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    best = max(tree.nodes, key=lambda n: ((n.score + n.bonus * (n.score > 0)) * (1 - n.linked / max(1, n.chars)), -n.order))
    top = best
    while best.inside and top.parent.inside:
        top = top.parent
    top.kept = True
    if not top.inside:
        least = max(3.0, best.score / 5)
        for node in tree.nodes:
            if node.parent is best.parent and best.parent is not None and node.score * (1 - node.linked / max(1, node.chars)) >= least:
                node.kept = True
    for node in tree.nodes[1:]:
        links = top.inside and node.tag in LISTS and 2 * node.linked > node.chars
        node.plain = node.parent.plain or (node.parent.kept and links and node.tag in ITEMS)
        node.kept = node.kept or node.parent.kept and not links
    out = []
    for node, text, linked in tree.blocks:
        sibling = not top.inside and node.parent is best.parent and best.parent is not None and (node.tag in HEADING or node.tag == "p") and linked < 0.25 * len(text)
        if sibling or node.kept or (node.plain and 2 * linked <= len(text)):
            out.append(text)
    return out or [text for _, text, _ in tree.blocks]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html)) if html else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages: its article by main_blocks(), blocks joined by an empty line.

    Null, empty or text-free html gives an empty text and 0 characters. White space in a block is one space; the text is not cut, however
    long or deep the page. Of containers with equal points the first counts. A null page_id or url is kept. Rows that repeat each get a row; an
    empty table gives none; other columns, also ones named text or n_chars, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
