"""Toxicity: a noisy channel undoes disguised spelling under a character language model; the restored text is scored."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain as chained

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, plain_names, table, tidy
from .labelled import fold, training_sample

#: Letters that a symbol or digit may stand for.
LOOKALIKES = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "€": "e", "6": "g", "9": "g", "#": "h", "1": "il", "!": "il", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}
#: Characters that may stand between the letters of one word.
FILLERS = frozenset(".-_*~'·,:;/\\^`\"=")
#: Costs in nats: a look-alike, an unmeant symbol, a digit dropped, a filler, a repeat dropped from a run of three or more or of two, a word end between spaced letters, a space dropped between tokens.
LOOKALIKE, SYMBOL, DIGIT, FILLER, LONG_RUN, PAIR, WORD_END, SPACE = 0.7, 2.0, 6.0, 0.1, 0.3, 6.0, 2.0, 2.0
#: Characters of tokens that are joined with each other (a longer one only with a token of one character), and tokens of one character in a row that are taken for spaced letters.
SHORT, SPELT = 4, 4
#: Labelled rows to learn from, and features kept of them.
TRAINING_ROWS, FEATURES = 20_000, 4096
#: Restored pieces that a worker remembers.
REMEMBERED = 100_000
KINDS = 64
_AGAIN = re.compile(r"(.)\1")
_THRICE = re.compile(r"(.)\1\1")
_LIKE = frozenset(LOOKALIKES)
_TAIL = re.compile(r"([^\w\s])\1{2,}")
#: From the first to the last character that is no letter.
_SIGNS = re.compile(r"[\W\d_](?:.*[\W\d_])?", re.S)
#: Size of a long token whose ends have not been asked for.
LONG = 1 << 62


def kind(cp: np.ndarray) -> np.ndarray:
    """Letters of the language model: 0 a word's end, 1 to 26 a to z, the rest other letters by code point."""
    out = np.zeros(len(cp), np.int64)
    az = (cp >= 97) & (cp <= 122)
    out[az] = cp[az] - 96
    wide = cp >= 0xAA
    out[wide] = 27 + cp[wide] % 37
    return out


def kind_of(letter: str) -> int:
    """The kind of one character."""
    cp = ord(letter)
    return cp - 96 if 97 <= cp <= 122 else 27 + cp % 37 if cp >= 0xAA else 0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of three letters in a row over all texts, by kind: each task adds up its own, Spark the tasks'. At most KINDS ** 3 rows arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS**3, np.int64)
        for batch in batches:
            for i in range(0, len(batch), 256):
                joined = "  ".join(x for x in batch.column(0).slice(i, 256).to_pylist() if x).lower()
                for a in range(0, len(joined), 1 << 20):
                    k = kind(np.frombuffer((" " + joined[max(0, a - 1) : a + (1 << 20)] + " ").encode("utf-32-le", "replace"), np.uint32))
                    code = (k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:]
                    total += np.bincount(code, minlength=KINDS**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["code", "n"])

    out = np.zeros(KINDS**3)
    for row in docs.select("text").mapInArrow(tidy("toxicity", run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[row.code] = row.n
    return out


class Channel:
    """Restores pieces of text: the cheapest path through a lattice of what each character may stand for."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(KINDS, KINDS, KINDS)
        pair = cube.sum(2, keepdims=True)
        middle = cube.sum(0)
        back = (middle + 0.5) / (middle.sum(1, keepdims=True) + 0.5 * KINDS)
        self._hold(-np.log((cube + 4 * back[None]) / (pair + 4)))

    @classmethod
    def of_costs(cls, cost: np.ndarray) -> Channel:
        """A channel of costs worked out before; a worker keeps the last one, and what it remembers, from task to task."""
        key = zlib.crc32(cost.tobytes())
        channels = held("toxicity")
        if key not in channels or not np.array_equal(channels[key].cost, cost):
            own = cls.__new__(cls)
            own._hold(cost)
            channels.clear()
            channels[key] = own
        return channels[key]

    def _hold(self, cost: np.ndarray) -> None:
        # single numbers are read faster from a list; a state is KINDS * kind before + last kind, a place KINDS * state + next kind
        self.cost, self.flat = cost, cost.ravel().tolist()
        self.known: dict[str, str] = {}
        self.words: dict[str, tuple[str, ...]] = {}
        self.edges: dict[str, tuple[str | None, str | None, int]] = {}
        self.ends: dict[str, bool] = {}
        self.pairs: dict[str, bool] = {}

    def _single(self, word: str) -> str:
        """A word of letters, none thrice in a row, without the doubled letters that the lattice drops: the letters on either side of a pair decide it alone."""
        out, last = [], ""
        for i, c in enumerate(word):
            if c == last:
                around = word[max(0, i - 2) : i + 2]
                if i < 2:
                    around = "<" + around
                drop = self.pairs.get(around)
                if drop is None:
                    a, c1, _, *d = [kind_of(x) if x != "<" else 0 for x in around]
                    at = lambda x, y, z: self.flat[(x * KINDS + y) * KINDS + z]
                    d = d[0] if d else 0
                    drop = self.pairs[around] = PAIR + at(a, c1, d) < at(a, c1, c1) + at(c1, c1, d)
                if drop:
                    continue
            out.append(c)
            last = c
        return "".join(out)

    def restore(self, piece: str) -> str:
        """The piece (in lower case) in plain letters; "" if nothing is left. Spaces in it may be word ends or not."""
        if piece.isalpha() and not _AGAIN.search(piece):
            return piece  # a lattice of one path
        if piece.isalpha() and not _THRICE.search(piece):
            return self._single(piece)
        said = self.known.get(piece)
        if said is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            said = self.known[piece] = self._viterbi(piece)
        return said

    def _restored(self, token: str) -> str:
        """The restored token: of the letters before its first sign and after its last, the lattice needs the two by the sign alone, where these are sure."""
        signs = _SIGNS.search(token)
        if not signs:
            return self.restore(token)
        left, right, start, end = "", "", signs.start(), signs.end()
        if start > 2 and token[start - 3] != token[start - 2] != token[start - 1]:
            head = token[:start]
            if head.isalpha() and not _THRICE.search(head):
                left = self.restore(head)[:-2]
                token, end = token[start - 2 :], end - start + 2
        if len(token) > end + 2 and token[end] != token[end + 1]:
            tail = token[end:]
            if tail.isalpha() and not _THRICE.search(tail):
                right = self.restore(tail)[2:]
                token = token[: end + 2]
        return left + self.restore(token) + right

    def _viterbi(self, said: str) -> str:
        # columns: what may be meant, as (kind or None, letter, cost), and the prices of going on and of ending a word before it
        tokens = said.split(" ")
        piece, gaps = "".join(tokens), {}
        if len(tokens) > 1:
            at, spelt, runs = 0, 0, []
            for token in tokens:
                spelt = spelt + 1 if len(token) == 1 else 0
                runs.append(spelt)
            for n in range(len(tokens) - 2, -1, -1):
                if runs[n] and runs[n + 1]:
                    runs[n] = runs[n + 1]
            for n in range(len(tokens) - 1):
                at += len(tokens[n])
                gaps[at] = (0.0, WORD_END) if runs[n] >= SPELT and runs[n + 1] >= SPELT else (SPACE, 0.0)
        flat, low = self.flat, KINDS - 1
        states: dict[int, tuple] = {0: (0.0, None)}  # what was said is a chain of (before, letters)
        for i, c in enumerate(piece):
            again = i and piece[i - 1] == c
            ways = []
            if c.isalpha():
                ways.append((kind_of(c), c, 0.0))
                if again:
                    ways.append((None, "", LONG_RUN if piece[i - 2 : i - 1] == c or piece[i + 1 : i + 2] == c else PAIR))
            else:
                ways += [(kind_of(x), x, LOOKALIKE) for x in LOOKALIKES.get(c, "")]
                run = again and (piece[i - 2 : i - 1] == c or piece[i + 1 : i + 2] == c)
                ways.append((None, "", FILLER if c in FILLERS else LONG_RUN if run else DIGIT if c.isdigit() else SYMBOL))
            if i in gaps:
                on, end = gaps[i]
                starts = []
                for state, (cost, chain) in states.items():
                    starts.append((state, cost + on, chain))
                    if chain and state & low:
                        starts.append(((state & low) * KINDS, cost + end + flat[state * KINDS], (chain, " ")))
            else:
                starts = [(state, cost, chain) for state, (cost, chain) in states.items()]
            states = {}
            for state, cost, chain in starts:
                for k, letter, price in ways:
                    if k is None:
                        to, total, then = state, cost + price, chain
                    else:
                        to, total, then = (state & low) * KINDS + k, cost + price + flat[state * KINDS + k], (chain, letter)
                    if to not in states or total < states[to][0]:
                        states[to] = (total, then)
        chain = min(((cost + (flat[state * KINDS] if chain and state & low else 0.0), n, chain) for n, (state, (cost, chain)) in enumerate(states.items())), default=(0, 0, None))[2]
        letters = []
        while chain:
            chain, letter = chain
            letters.append(letter)
        return "".join(reversed(letters)).strip()

    def apart(self, left: str, right: str) -> bool:
        """Whether two ends of tokens, of two sure letters each, belong to two words. These letters alone decide it, whatever stands around them."""
        cost = lambda *k: self.flat[(k[0] * KINDS + k[1]) * KINDS + k[2]]
        (w, x), (y, z) = map(kind_of, left), map(kind_of, right)
        return cost(w, x, 0) + cost(x, 0, y) + cost(0, y, z) < SPACE + cost(w, x, y) + cost(x, y, z)

    def _readings(self, piece: str) -> tuple[str, ...]:
        """The words of a token that stands alone: without signs around it, with a look-alike before it, and, of a token with a run of signs inside it, also each part."""
        if piece.isalpha():
            return (self.restore(piece),)
        plain = piece.strip(_AROUND)
        if plain.isalpha() and _BEFORE.isdisjoint(piece):
            return (self.restore(plain),)
        if piece.isdigit():
            return ()
        out: dict[str, None] = {}
        parts = _TAIL.sub(" ", piece).split() if _TAIL.search(piece) else []
        for said in (piece, *parts):
            plain = said.strip(_AROUND)
            begins = said[: len(said) - len(said.lstrip(_AROUND))]
            for x in (plain, begins[-1] + plain) if plain and begins[-1:] in _BEFORE else (plain,):
                if (len(x) > 1 or x.isalpha()) and not x.isdigit():
                    out.update(dict.fromkeys(self._restored(x).split()))
        return tuple(out)

    def pieces(self, text: str) -> set[str]:
        """The distinct restored words of a text: of each token by itself, and of the lattice over runs of short tokens, and of longer ones beside single letters.

        A run's lattice is cut where what is meant is sure: between two tokens with two sure letters each at the space, and in a token with such letters. What lies between
        is decoded, and remembered, by its ends alone; what is joined is put together again. Numbers of two digits or more stand alone.
        """
        split = text.lower().split()
        if len(self.words) > REMEMBERED:
            self.words.clear()
            self.edges.clear()
        words, edges, ends = self.words, self.edges, self.ends
        distinct = set(split)
        for piece in distinct:
            if piece not in words:
                plain = piece.strip(_AROUND)
                words[piece] = (plain,) if plain.isalpha() and not _AGAIN.search(plain) and (plain == piece or _BEFORE.isdisjoint(piece)) else self._readings(piece)
                if len(piece.strip(_DASHES)) <= SHORT:
                    edges[piece] = _edge(piece)
        out = set(chained.from_iterable(map(words.__getitem__, distinct)))
        said, part, before, tail, last, size = "", [], "", None, "", 0  # what is joined so far; the tokens that are not decided yet; the token before, its end, last sign and length
        for token, edge in zip(split, map(edges.get, split)):
            if edge is None:  # a long token, of which most stand beside others that are not joined with it
                if size != 1:
                    if said or len(part) > 1:
                        self._end(said, part, out)
                        said = ""
                    part, before, size = (), token, LONG
                    continue
                edge = _edge(token)
            head, tail_here, n = edge
            if size == LONG:
                if n > 1:
                    part, before, tail, last, size = [token], token, tail_here, token[-1], n
                    continue
                part, tail, last = [before], _edge(before)[1], before[-1]
            elif n > SHORT and size != 1 or size > SHORT and n > 1:
                if said or len(part) > 1:
                    self._end(said, part, out)
                said, part, before, tail, last, size = "", [token], token, tail_here, token[-1], n
                continue
            how = None
            if head is _NUMBER or not before:
                how = True
            elif tail and head and last != token[0]:
                how = ends.get(tail + head)
                if how is None:
                    how = ends[tail + head] = self.apart(tail, head)
            if how is None:
                part.append(token)
            else:
                if not how:
                    said += self._decoded(part)
                elif said or len(part) > 1:
                    self._end(said, part, out)
                    said = ""
                part = [token]
            if head is _NUMBER:
                part, before, tail, last, size = [], "", None, "", 0
            else:
                # of two letters, the first may be a repeat of the one before, which leaves the token's end open
                open_end = before and last == token[0] and tail_here == head and len(_sure(token)) < 3
                before, tail, last, size = token, None if open_end else tail_here, token[-1], n
        self._end(said, part, out)
        return out

    def _end(self, said: str, part: list[str], out: set[str]) -> None:
        if said or len(part) > 1:
            out.update((said + self._decoded(part)).split())

    def _decoded(self, part: list[str]) -> str:
        """The restored text of tokens in a row, of the first and the last of which only the ends by the space are in doubt."""
        if len(part) == 1:
            return self.restore(part[0])
        first, last, left, right = part[0], part[-1], "", ""
        if len(first) > 2 and (self.edges.get(first) or _edge(first))[1]:
            at = [i for i, c in enumerate(first) if c.isalpha()][-2]
            left, first = self.restore(first)[:-2], first[at:]
        if len(last) > 3:
            # one letter more where the first may be a repeat
            sure, kept = _sure(last), 3 if part[-2][-1] == last[0] else 2
            if len(sure) > kept and sure[0] != sure[1] and sure[kept - 2] != sure[kept - 1]:
                at = [i for i, c in enumerate(last) if c.isalpha()][kept - 1]
                right, last = self.restore(last)[kept:], last[: at + 1]
        return left + self.restore(" ".join((first, *part[1:-1], last))) + right


_NUMBER = "0"
#: Signs around a word, and those of them that may also stand for a letter.
_AROUND = ".,;:?\"'()[]{}«»¿¡…-–—"
_DASHES = "-–—"
_BEFORE = frozenset(c for c in _AROUND if c in LOOKALIKES)


def _edge(token: str) -> tuple[str | None, str | None, int]:
    """The two letters that a token begins and ends with, where they are sure, and its size without hyphens around it; a number of two digits or more stands alone."""
    if token.isdigit() and len(token) > 1:
        return _NUMBER, None, len(token)
    sure, size = _sure(token), len(token.strip(_DASHES))
    if len(sure) < 2:
        return None, None, size
    return (sure[:2] if sure[0] != sure[1] else None), (sure[-2:] if sure[-1] != sure[-2] else None), size


def _sure(token: str) -> str:
    """The letters of a token in which nothing but one of a doubled letter is in doubt, else nothing."""
    if token.isalpha():
        return "" if _THRICE.search(token) else token
    return "" if _THRICE.search(token.rstrip(".")) or not _LIKE.isdisjoint(token) else "".join(filter(str.isalpha, token))


def features(word: str) -> list[int]:
    """The word and its beginnings, as hashes."""
    out = [zlib.crc32(word.encode())]
    for n in (3, 5, 7):
        if len(word) <= n:
            break
        out.append(n << 32 | zlib.crc32(word[:n].encode()))
    return out


class Model:
    """Logistic regression on which features a text has."""

    def __init__(self, channel: Channel, weights: dict[int, float], bias: float):
        self.channel, self.weights, self.bias = channel, weights, bias
        self.seen: dict[str, tuple] = {}
        self.idle: set[str] = set()

    def score(self, text: str | None) -> float:
        found: dict[int, float] = {}
        if text:
            if len(self.seen) + len(self.idle) > REMEMBERED:
                self.seen.clear()
                self.idle.clear()
            weighs = self.weights.keys()
            for word in self.channel.pieces(text) - self.idle:  # words without weight are left out all at once
                has = self.seen.get(word)
                if has is None:
                    own = features(word)
                    if weighs.isdisjoint(own):
                        self.idle.add(word)
                        continue
                    has = self.seen[word] = tuple((f, self.weights[f]) for f in own if f in weighs)
                found.update(has)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(sorted(found.values()))))))


def fit_logistic(rows: list[list[int]], label: np.ndarray, n: int, decay: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on presence features, by full-batch Adam."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    w, b = np.zeros(n), math.log((label.sum() + 1) / (len(label) - label.sum() + 1))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col], len(rows)) + b)))
        e = p - label
        g, gb = np.bincount(col, e[row], n) + decay * w, e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * (1 - t / (steps + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, most: int = TRAINING_ROWS, kept: int = FEATURES) -> Model:
    """The channel from all texts, and the regression from at most `most` labelled rows outside the held-out fold.

    The `kept` features whose document counts tell most about the label take part. Without labelled rows, every score is 0.5.
    """
    spark = docs.sparkSession
    channel = Channel(trigram_counts(docs))
    sent = spark.sparkContext.broadcast(channel.cost)  # KINDS ** 3 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Channel.of_costs(sent.value)
        for batch in batches:
            for i in range(0, len(batch), 128):
                texts, marks = batch.column(0).slice(i, 128).to_pylist(), batch.column(1).slice(i, 128)
                has = [sorted({f for word in own.pieces(x or "") for f in features(word)}) for x in texts]
                yield pa.RecordBatch.from_arrays([marks, pa.array(has, pa.list_(pa.int64()))], ["label", "has"])

    sample = training_sample(docs, labels, label, folds, held_out, most).withColumn("label", F.col("label").cast("int"))
    rows = table(sample.mapInArrow(tidy("toxicity", run), "label int, has array<bigint>"), "toxicity-sample")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return Model(channel, {}, 0.0)
    counts = rows.select("label", F.explode("has").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).where("n >= 3")
    rest, k, m = n - positive, F.col("k").cast("double"), (F.col("n") - F.col("k")).cast("double")
    part = lambda x, whole, total: F.when(x > 0, x * F.log(x * n / (F.lit(float(total)) * whole))).otherwise(0.0)
    gain = part(k, F.col("n"), positive) + part(m, F.col("n"), rest) + part(F.lit(float(positive)) - k, n - F.col("n"), positive) + part(F.lit(float(rest)) - m, n - F.col("n"), rest)
    best = counts.withColumn("gain", gain).where("gain > 4").orderBy(F.desc("gain"), "f").limit(kept)
    index = {r.f: i for i, r in enumerate(best.select("f").collect())}
    chosen = F.array(*[F.lit(f) for f in index]) if index else F.array().cast("array<bigint>")
    data = rows.select("label", F.array_intersect("has", chosen).alias("has")).collect()  # at most `most` rows
    data.sort(key=lambda r: (r.label, r.has))
    w, b = fit_logistic([[index[f] for f in r.has] for r in data], np.array([r.label for r in data], float), len(index))
    return Model(channel, {f: float(w[i]) for f, i in index.items()}, float(b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic) of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((model.channel.cost, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel.of_costs(sent.value[0])
        own = Model(channel, *sent.value[1:])
        for batch in batches:
            out = np.array([own.score(x) for i in range(0, len(batch), 64) for x in batch.column(1).slice(i, 64).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy("toxicity", run), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    Whole texts are restored and scored; null and empty texts get the score of no evidence. labels: doc_id, toxic; null doc_id or
    toxic is ignored, and of labels that repeat a doc_id the highest counts. Rows that repeat score alike. An empty table gives no rows;
    other columns are ignored.
    """
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score is under the threshold, with the columns of docs.

    Each row is decided by its own whole text: a null doc_id, ties and rows that repeat play no part. Null and empty texts get the score of no
    evidence. Without labels every score is 0.5. An empty table gives no rows; columns of docs may have any names.
    """
    model = train(docs.select("doc_id", "text"), labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.channel.cost, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel.of_costs(sent.value[0])
        own = Model(channel, *sent.value[1:])
        for batch in batches:
            at = batch.schema.get_field_index("text")
            good = [i + j for i in range(0, len(batch), 64) for j, x in enumerate(batch.column(at).slice(i, 64).to_pylist()) if own.score(x) < threshold]
            yield batch.take(pa.array(good, pa.int64()))

    rows = plain_names(docs)
    return rows.mapInArrow(tidy("toxicity", run), rows.schema).toDF(*docs.columns)
