"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = WORDS.findall((text or "").translate(AZ))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def similar_components(docs, n=5, num=75, den=100):
    """docs: (doc_id, text) -> {doc_id: (n_shingles, component_id)}."""
    sets = {i: shingles(t, n) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                shared[ids[a], ids[b]] += 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (a, b), both in shared.items():
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeated_bytes(docs, width=200):
    """docs: (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, kept)}: removal of bytes in strings of `width` bytes that start twice."""
    raw = {i: (t or "").encode() for i, t in docs}
    seen = defaultdict(int)
    for b in raw.values():
        for p in range(len(b) - width + 1):
            seen[b[p : p + width]] += 1
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = b"\x01" * width
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out


def plain(text):
    """Lower case A-Z, runs of ASCII punctuation, controls and white space as one space."""
    return re.sub(r"[\x00-\x7f]+", lambda m: re.sub(r"[^a-z0-9]+", " ", m[0]), (text or "").translate(AZ)).strip()


def least_edits(pattern, text):
    """Least edits that turn pattern into some part of text."""
    above = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (p != t)))
        above = row
    return min(above)


def contaminated(docs, items, bounds, q):
    """{(doc_id, item_id): (least edits of a segment, segments held)}."""
    out = {}
    for d, text in docs:
        for i, item in items:
            t = plain(item)
            starts = {*range(0, max(1, len(t) - bounds.segment + 1), bounds.stride), *([len(t) - bounds.segment] if len(t) > bounds.segment else [])}
            held = []
            for s in starts:
                segment = t[s : s + bounds.segment]
                n = least_edits(segment, plain(text))
                if n <= min(len(segment) // bounds.per_edit, (len(segment) - q) // q):
                    held.append(n)
            if held:
                out[d, i] = (min(held), len(held))
    return out


def cheapest(said, cost, lookalikes, prices, kind_of):
    """Cost and letters of all paths of a piece through the channel's lattice, cheapest first."""
    tokens = said.split(" ")
    lone = [len(t) == 1 for t in tokens]

    def spelt(n):
        a = b = n
        while a and lone[a - 1]:
            a -= 1
        while b + 1 < len(tokens) and lone[b + 1]:
            b += 1
        return lone[n] and b - a + 1 >= prices.SPELT

    gaps, at = {}, 0
    for n in range(len(tokens) - 1):
        at += len(tokens[n])
        gaps[at] = (0.0, prices.WORD_END) if spelt(n) and spelt(n + 1) else (prices.SPACE, 0.0)
    piece, out = "".join(tokens), []

    def walk(i, a, b, total, letters):
        if i == len(piece):
            out.append((total + (cost[a][b][0] if letters and b else 0.0), letters.strip()))
            return
        c, on = piece[i], 0.0
        starts = [(a, b, total, letters)]
        if i in gaps:
            on, end = gaps[i]
            starts = [(a, b, total + on, letters), *([(b, 0, total + end + cost[a][b][0], letters + " ")] if letters and b else [])]
        again = i > 0 and piece[i - 1] == c
        run = again and (piece[i - 2 : i - 1] == c or piece[i + 1 : i + 2] == c)
        if c.isalpha():
            ways = [(c, 0.0), *([("", prices.LONG_RUN if run else prices.PAIR)] if again else [])]
        else:
            ways = [*((x, prices.LOOKALIKE) for x in lookalikes.get(c, "")), ("", prices.FILLER if c in prices.FILLERS else prices.LONG_RUN if run else prices.DIGIT if c.isdigit() else prices.SYMBOL)]
        for a1, b1, t1, l1 in starts:
            for x, price in ways:
                k = kind_of(x) if x else None
                walk(i + 1, *((b1, k, t1 + price + cost[a1][b1][k]) if x else (a1, b1, t1 + price)), l1 + x)

    walk(0, 0, 0, 0.0, "")
    return sorted(out)
