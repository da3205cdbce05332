"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: Expected copies are whole multiples of 1 / SCALE, so that prefix sums are exact.
SCALE = 1 << 30
#: Documents of a source that one window orders; the blocks' sums are chained.
BLOCK = 256


def _hash32(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, n, source_size, target of each source in (source, size).

    The sources in code point order, null last, take the weights in turn. Their targets share the sum of all sizes by weight;
    none is above `cap` times its source's size, and what is cut goes to the others by weight. Sorted by cap / weight, the cut
    sources come first, so that one pass of running sums finds the level. One row per source meets in one window.
    """
    # without a partition: one row per source, not per document
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_limit = everything.orderBy("limit_ratio", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    return (
        sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), place.cast("int")))
        .withColumn("limit_ratio", (F.col("source_size") * cap).cast("double") / F.col("weight"))
        .withColumn("rank", F.row_number().over(by_limit))
        .withColumn("level", level)
        .withColumn("free", F.col("limit_ratio") > F.col("level"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct("rank", "level"))).over(everything)["level"])
        .select("source", "n", "source_size", F.when(F.col("free"), F.col("weight") * F.col("level")).otherwise((F.col("source_size") * cap).cast("double")).alias("target"))
    )


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 1, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (and the columns named in carry) of each row of docs.

    A document's size is its number of words, 0 for a null or empty text. Its expected copies are its source's target over its
    source's size. Blocks of a source (by a hash of doc_id; a hot source has many) order their documents by size; the prefix sum
    of expected copies runs through the blocks, starts at one random offset per source (from seed), and a document is taken once
    per whole number that its part of the sum crosses. Size order keeps the words taken within one document's size of the target
    per block. Rows with equal doc_id, source and size are interchangeable; the result is the same in every run. A null source
    is a source; a null doc_id is a document; an empty table gives no rows; other columns are ignored.
    """
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
    if not carry:
        sizes = table(sizes, "mix-sizes")
    sources = table(source_targets(sizes.select("source", "size"), weights, cap), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * SCALE)).otherwise(0).cast("long")
    sources = sources.select(F.col("source").alias("of"), "n", "source_size", "target", rate.alias("rate"), (F.floor(_hash32(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("\x00")))) / 4)).cast("long").alias("offset"))
    part = F.pmod(_hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.ceil(F.col("n") / block).cast("long"))
    rows = sizes.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("part", part)
    if carry:
        counts = docs.select("doc_id", "source").join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("part", part)
    else:
        counts = rows
    # rows of all earlier blocks of the source
    earlier = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(F.col("source").alias("s"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("held"))
    blocks = blocks.withColumn("earlier", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    tie = [F.xxhash64(*[f"carried_{i}" for i in range(len(carry))])] if carry else []
    within = Window.partitionBy("source", "part").orderBy("size", F.col("doc_id").asc_nulls_first(), *tie)
    start = (F.col("earlier") % SCALE) * F.col("rate") % SCALE + F.col("offset")
    crossed = lambda k: F.floor((F.col("start") + k * F.col("rate")) / F.lit(SCALE).cast("decimal(20,0)")).cast("long")
    return (
        rows.withColumn("k", F.row_number().over(within).cast("long"))
        .join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .withColumn("start", start)
        .withColumn("copies", crossed(F.col("k")) - crossed(F.col("k") - 1))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 1) -> DataFrame:
    """The rows of docs, each as often as mix_plan takes it, with the columns of docs."""
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    # names of docs may be names of the plan, too
    inner = docs.select(F.col("doc_id"), F.col("source"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")) if carried else docs
    plan = mix_plan(inner, weights, cap, seed, carry=("row",) if carried else ())
    taken = plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) if c in carried else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
g AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM g),
r AS (SELECT *, (source_size * 3)::DOUBLE / weight AS lim FROM w),
l AS (SELECT *, row_number() OVER o AS rn, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY lim, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY lim, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r WINDOW o AS (ORDER BY lim, encode(source) NULLS LAST)),
f AS (SELECT arg_min(level, rn) AS level FROM l WHERE lim > l.level),
t AS (SELECT l.source, n, source_size, CASE WHEN lim > l.level THEN weight * f.level ELSE (source_size * 3)::DOUBLE END AS target,
      ('0x' || substr(md5('1|' || coalesce(l.source, chr(0))), 1, 8))::BIGINT // 4 AS off FROM l LEFT JOIN f ON true),
d AS (SELECT s.doc_id, s.source, size, source_size, target, off, CASE WHEN source_size > 0 THEN round(target / source_size * 1073741824) ELSE 0 END::BIGINT AS rate,
      ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT % ((n + 255) // 256) AS part FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY part, size, doc_id NULLS FIRST) AS k,
      count(*) OVER (PARTITION BY source ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY source, part) AS earlier FROM d),
c AS (SELECT *, (earlier::HUGEINT * rate) % 1073741824 + off + (k - earlier) * rate AS upto FROM k)
SELECT doc_id, size, source_size, target, ((upto // 1073741824) - ((upto - rate) // 1073741824))::BIGINT * size AS taken,
       ((upto // 1073741824) - ((upto - rate) // 1073741824))::BIGINT AS copies FROM c
"""
