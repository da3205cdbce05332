"""Document fingerprints: SimHash of weighted words, and a search of near fingerprints by permuted block tables. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, partitions, table

#: Buckets of words whose document frequencies give the weights: the table of weights has a row per bucket at most, so that it can be broadcast.
WEIGHT_BUCKETS = 1 << 16
#: Votes of a word; with 15 at most, a text may have 143 million different words before a 31-bit lane is full.
MOST_VOTES = 15
#: Bits in which near fingerprints of 128 bits may differ.
RADIUS = 6
#: Parts of a hot block key.
SALTS = 8
#: Two 32-bit lanes of a 64-bit sum.
_LANES, _LOW = 0x0000000100000001, 0xFFFFFFFF
#: Bytes of an order key.
_KEY = 33


def _words(text: Column) -> Column:
    """The words of a text; empty strings among them count for nothing."""
    return F.split(F.lower(text), rf"[{SPACE}]+")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(WEIGHT_BUCKETS - 1)


def _votes(n: int, holders: Column) -> Column:
    """Votes of a word that `holders` of n documents hold: 1 for one that all hold, two more per factor e of rarity."""
    return F.least(F.lit(MOST_VOTES), F.greatest(F.lit(0), F.round(2 * F.log((F.lit(n) + 1.0) / holders)).cast("long")) + 1).cast("long")


def word_votes(docs: DataFrame, n: int) -> DataFrame:
    """of (bucket of a word's hash), votes: from the documents that hold words of that bucket, over all of docs (text)."""
    held = docs.select(F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("word")).where("word != ''")
    return held.groupBy(_bucket(F.xxhash64("word")).alias("of")).agg(F.count(F.lit(1)).alias("holders")).select("of", _votes(n, F.col("holders")).alias("votes"))


def simhash(texts: DataFrame, keys: list[str], text: str, votes: DataFrame, n: int) -> DataFrame:
    """keys, f1, f2: the two halves of each text's 128-bit fingerprint; keys (columns of texts) tell rows apart.

    Each different word votes for or against each bit, as its hash has it, once or more often, as `votes` has it. A bit is set if more votes are for it than against. The votes for two bits are
    added in the two lanes of one number. A text without words has the fingerprint 0.
    """
    said = texts.select(*keys, F.explode(F.array_distinct(_words(F.col(text)))).alias("word")).select(*keys, "word", F.xxhash64("word").alias("h1"))
    said = said.join(F.broadcast(votes), _bucket(F.col("h1")) == F.col("of"), "left")
    w = F.when(F.col("word") == "", F.lit(0).cast("long")).otherwise(F.coalesce("votes", _votes(n, F.lit(1.0))))
    said = said.select(*keys, "h1", F.xxhash64("h1").alias("h2"), w.alias("w"))
    sums = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(_LANES) * F.col("w")).alias(f"{h}_{i}") for h in ("h1", "h2") for i in range(32)]
    summed = said.groupBy(*keys).agg(F.sum("w").alias("w"), *sums)

    def half(h: str) -> Column:
        bits = []
        for i in range(32):
            bits.append(F.when(F.col(f"{h}_{i}").bitwiseAND(_LOW) * 2 > F.col("w"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
            high = (1 << i + 32) - (1 << 64 if i == 31 else 0)
            bits.append(F.when(F.shiftrightunsigned(f"{h}_{i}", 32) * 2 > F.col("w"), F.lit(high).cast("long")).otherwise(F.lit(0).cast("long")))
        return reduce(Column.bitwiseOR, bits)

    return summed.select(*keys, half("h1").alias("f1"), half("h2").alias("f2"))


def hex128(f1: str, f2: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Share of equal bits."""
    return 1 - _apart(a, b).cast("double") / 128


def _apart(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def _order_key(doc_id: Column, text: Column) -> Column:
    """33 bytes that ascend as doc_id descends (null last), then by a hash of the text."""
    down = F.bitwise_not(doc_id).bitwiseXOR(F.lit(-(1 << 63)))
    number = F.coalesce(F.concat(F.lit("0"), F.lpad(F.hex(down), 16, "0")), F.lit("1" + "0" * 16))
    return F.concat(number, F.lpad(F.hex(F.xxhash64(text)), 16, "0")).cast("binary")


def _starts(keys: DataFrame, parts: int) -> list[bytes]:
    """Where ranges of about even numbers of keys begin, ascending; the first is the least key. One key per range comes to the driver."""
    dealt = keys.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    return sorted({bytes(r.key) for r in dealt.select("key").collect()})


def _range_of(key: Column, starts: list[bytes]) -> Column:
    """The number of the range that holds a key, by binary search in one string of starts."""
    said = F.lit(b"".join(starts))
    steps = [1 << s for s in range(max(0, (len(starts) - 1).bit_length()) - 1, -1, -1)]
    if not steps:
        return F.lit(0)
    at = lambda i: F.substring(said, i * _KEY + 1, F.lit(_KEY))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when((low + s < len(starts)) & (at(low + s) <= key), low + s).otherwise(low))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, f1, f2, e1, e2, near_next (likeness to the next document) of each row of docs.

    The next document is that of the next lower doc_id (null is the least; of a doc_id that repeats, by a hash of the text), after the last the first. The
    edited text is a text whose last half (floor of code points) gives way to as much of the next document's beginning. Ranges of doc_id hold rows in
    order, and the first row of each is a guest at the end of the range before, so that texts are shuffled once and no window spans all rows.
    Null counts as an empty text; rows that repeat are rows of their own, each the other's next, and of equal fingerprint; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", _order_key(F.col("doc_id"), F.col("text")))
    starts, n = _starts(rows.select("key"), 2 * partitions(spark)), rows.count()
    votes = word_votes(rows, n)
    ranged = rows.withColumn("own", _range_of(F.col("key"), starts))
    first = F.substring(F.lit(b"".join(starts)), F.col("own") * _KEY + 1, F.lit(_KEY)) == F.col("key")
    before = F.pmod(F.col("own") - 1, F.lit(max(1, len(starts))))
    ranged = ranged.select("doc_id", "text", "key", F.posexplode(F.when(first, F.array("own", before)).otherwise(F.array("own"))).alias("guest", "part"))
    order = Window.partitionBy("part").orderBy("guest", "key")
    size = F.length("text").cast("long")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (size - half).cast("int")), F.substring(F.lead("text").over(order), F.lit(1), half))
    ranged = ranged.select("part", "guest", F.row_number().over(order).alias("nth"), "doc_id", "text", size.alias("n_chars"), edited.alias("edited"))
    ranged = ranged.select("part", "guest", "nth", "doc_id", "n_chars", "text", "edited", F.when(F.col("guest") == 0, F.sha2("edited", 256)).otherwise("").alias("edited_sha256"))
    keys = ["part", "guest", "nth", "doc_id", "n_chars", "edited_sha256"]
    both = F.when(F.col("guest") == 0, F.array("text", "edited")).otherwise(F.array("text"))
    texts = ranged.select(*keys, F.posexplode(both).alias("version", "said"))
    found = simhash(texts, [*keys, "version"], "said", votes, n)
    found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("version") == v, F.col(f))).alias(f"{name}{f[1]}") for v, name in ((0, "f"), (1, "e")) for f in ("f1", "f2")])
    order = Window.partitionBy("part").orderBy("guest", "nth")
    found = found.withColumns({"n1": F.lead("f1").over(order), "n2": F.lead("f2").over(order)}).where("guest = 0")
    return found.select("doc_id", "n_chars", "edited_sha256", "f1", "f2", "e1", "e2", likeness(("f1", "f2"), ("n1", "n2")).alias("near_next"))


def _mask(bits: int) -> int:
    return (1 << bits) - 1 if bits < 64 else -1


def block_keys(f1: str, f2: str, part: Column, radius: int = RADIUS) -> Column:
    """An entry (key, below, want) for each permuted block table, an array; `part` is the part of the key's group.

    128 bits are cut into at least two blocks more than the radius, so that near fingerprints agree in two blocks or more. The table of blocks i < j moves
    these to the front as its key. Of the tables that a pair shares, the one of the two lowest common blocks reports it: among
    common blocks up to j (`below`), just i and j are set (`want`).
    """
    per = (radius + 3) // 2  # blocks of a half
    width = [64 * (k + 1) // per - 64 * k // per for k in range(per)] * 2
    start = [64 * k // per for k in range(per)] * 2
    block = [F.shiftrightunsigned(f1 if k < per else f2, start[k]).bitwiseAND(_mask(width[k])) for k in range(2 * per)]
    entries = []
    for number, (i, j) in enumerate(combinations(range(2 * per), 2)):
        key = F.xxhash64(F.lit(number), block[i], block[j], part)
        entries.append(F.struct(key.alias("key"), F.lit((1 << j + 1) - 1).alias("below"), F.lit(1 << i | 1 << j).alias("want")))
    return F.array(*entries)


def _common(a: tuple[str, str], b: tuple[str, str], radius: int) -> Column:
    """A bit per block in which two fingerprints agree."""
    per = (radius + 3) // 2
    bits = []
    for k in range(2 * per):
        low, high = 64 * (k % per) // per, 64 * (k % per + 1) // per
        h = k // per
        apart = F.shiftrightunsigned(F.col(a[h]).bitwiseXOR(F.col(b[h])), low).bitwiseAND(_mask(high - low))
        bits.append(F.when(apart == 0, F.lit(1 << k)).otherwise(F.lit(0)))
    return reduce(Column.bitwiseOR, bits)


def near_fingerprints(held: DataFrame, asked: DataFrame, radius: int = RADIUS, more: tuple[str, ...] = ()) -> DataFrame:
    """q1, q2, f1, f2, apart (and the columns of held named in more): of each different fingerprint of asked, all rows of held that differ in at most `radius` bits (itself, too, if held).

    Both tables (f1, f2) are met in permuted block tables, each pair once. Keys of `held` are dealt over SALTS parts, and those of `asked` go to each, so
    that a group of many near fingerprints does not meet in one task.
    """
    if not 0 <= radius <= 30:
        raise ValueError("a radius of 0 to 30 bits")
    own = F.pmod(F.xxhash64("f1", "f2"), F.lit(SALTS)).cast("int")
    left = held.select("f1", "f2", *more, F.explode(F.transform(block_keys("f1", "f2", own, radius), lambda e: e["key"])).alias("key"))
    asked = asked.select(F.col("f1").alias("q1"), F.col("f2").alias("q2")).distinct().withColumn("part", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
    right = asked.select("q1", "q2", F.explode(block_keys("q1", "q2", F.col("part"), radius)).alias("e")).select("q1", "q2", "e.*").withColumnRenamed("key", "asked")
    q, f = ("q1", "q2"), ("f1", "f2")
    on = (F.col("key") == F.col("asked")) & (_apart(q, f) <= radius) & (_common(q, f, radius).bitwiseAND(F.col("below")) == F.col("want"))
    # neither side has a bound, and Spark's estimates leave out what explode() adds: both are shuffled
    return left.hint("merge").join(right, on).select("q1", "q2", "f1", "f2", _apart(q, f).alias("apart"), *more)


def fingerprint_report(docs: DataFrame, radius: int = RADIUS, every: int = 100) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_docs of each row of docs.

    near_docs: other rows whose fingerprint differs in at most `radius` bits, asked for rows whose doc_id is divisible by `every` (else null). See
    document_fingerprints for rows that are null, empty, equal or none.
    """
    found = table(document_fingerprints(docs), "fingerprints")
    rows = found.select("doc_id", "n_chars", "edited_sha256", hex128("f1", "f2").alias("fingerprint"), hex128("e1", "e2").alias("edited_fingerprint"), likeness(("f1", "f2"), ("e1", "e2")).alias("near_edited"), "near_next", "f1", "f2")
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    held = found.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("copies"))
    counts = near_fingerprints(held, found.where(asks), radius, ("copies",)).groupBy("q1", "q2").agg(F.sum("copies").alias("near"))
    asked = rows.where(asks).join(counts, (F.col("f1") == F.col("q1")) & (F.col("f2") == F.col("q2")), "left").withColumn("near_docs", F.col("near") - 1)
    return asked.drop("q1", "q2", "near").unionByName(rows.where(~asks).withColumn("near_docs", F.lit(None).cast("long"))).drop("f1", "f2")
