"""Metrics, lookups and reachability on nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import two_decimals
from ..model import IMPACT_TYPES
from ..runtime import cut


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, type): the first by edge_seq. Edges without an end are dropped."""
    real = edges.where("source != '' AND target != ''")
    return real.groupBy("source", "target", "type").agg(F.min("edge_seq").alias("edge_seq")).select("edge_seq", "source", "target", "type")


def summary(nodes: DataFrame, edges: DataFrame, hits: int = 0, misses: int = 0) -> DataFrame:
    """One row: nodes, by kind, and edges; repeated ids count."""
    kinds = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("module", "class", "function", "method")])
    return kinds.crossJoin(edges.agg(F.count(F.lit(1)).alias("total_edges"))).withColumns({"cache_hits": F.lit(hits).cast("long"), "cache_misses": F.lit(misses).cast("long")})  # one row by one row


def fan_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out, instability of each distinct id. All edge types count; ends that are no nodes are ignored."""
    ends = edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    ids = nodes.select("id").withColumns({"i": F.lit(0), "o": F.lit(0), "real": F.lit(True)})
    counts = ends.withColumn("real", F.lit(False)).unionByName(ids).groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.max("real").alias("real"))
    return counts.where("real").select("id", "fan_in", "fan_out", two_decimals(F.col("fan_out"), F.col("fan_in") + F.col("fan_out")).alias("instability"))


def edge_type_histogram(edges: DataFrame) -> DataFrame:
    """type, n, first_seq: the order of first_seq is that of first sight."""
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("edge_seq").alias("first_seq"))


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, direction, edge_seq, neighbour_id, neighbour_name, type: the edges of each node, in their order; a loop is both in and out."""
    names = nodes.groupBy(F.col("id").alias("of")).agg(F.min_by("name", "node_seq").alias("name"))
    sides = edges.select(F.col("target").alias("id"), F.lit("incoming").alias("direction"), "edge_seq", F.col("source").alias("neighbour_id"), "type").unionByName(edges.select(F.col("source").alias("id"), F.lit("outgoing").alias("direction"), "edge_seq", F.col("target").alias("neighbour_id"), "type"))
    named = sides.join(names, F.col("neighbour_id") == F.col("of"), "left").withColumn("neighbour_name", F.coalesce("name", "neighbour_id")).drop("of", "name")
    return named.join(names.select(F.col("of").alias("id")), "id", "left_semi")


def symbol_detail(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """The symbol that lookup finds, with its metrics; no row if there is none."""
    one = lookup(nodes, query).drop("module", "parent_id", "node_seq")
    return one.join(fan_metrics(one.select("id"), edges), "id")


def lookup(nodes: DataFrame, query: str) -> DataFrame:
    """The node with that id, else the first by node_seq with that name or whose id ends in a dot and it."""
    rank = F.when(F.col("id") == query, 0).when((F.col("name") == query) | F.col("id").endswith("." + query), 1)
    return nodes.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "node_seq").limit(1).drop("rank")


def view_lookup(nodes: DataFrame, query: str) -> DataFrame:
    """The first node by node_seq with that id or name, or whose id ends in it."""
    return nodes.where((F.col("id") == query) | (F.col("name") == query) | F.col("id").endswith(query)).orderBy("node_seq").limit(1)


def view_lookup_all(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id: view_lookup of many queries at once. Each id gives its ends of the lengths that queries have, so that "ends in" is an equality join, too.

    Of the nodes that share a key only the first is kept before the join, so that a short end that most ids have is one row.
    """
    asked = queries.select("query").where("query IS NOT NULL").distinct()
    lengths = [r.n for r in asked.select(F.length("query").alias("n")).distinct().collect()]  # no more than the longest query has letters
    fit = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n < F.length("id"))
    ends = nodes.select("id", "node_seq", F.explode(fit).alias("n")).select(F.substring(F.col("id"), F.length("id") - F.col("n") + 1, F.col("n")).alias("key"), "id", "node_seq")
    keys = nodes.select(F.col("id").alias("key"), "id", "node_seq").unionByName(nodes.select(F.col("name").alias("key"), "id", "node_seq")).unionByName(ends)
    first = keys.groupBy("key").agg(F.min_by("id", "node_seq").alias("id"))
    return asked.join(first, F.col("query") == F.col("key")).select("query", "id")


def lookup_all(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id: lookup of many queries at once, by equality joins on id, name and each suffix of the ids."""
    dots = F.expr("transform(sequence(1, greatest(size(split(id, '[.]')) - 1, 1)), i -> substring_index(id, '.', -i))")
    keys = nodes.select(F.col("id").alias("key"), "id", "node_seq", F.lit(0).alias("rank")).unionByName(nodes.select(F.col("name").alias("key"), "id", "node_seq", F.lit(1).alias("rank")))
    keys = keys.unionByName(nodes.where("id LIKE '%.%'").select(F.explode(dots).alias("key"), "id", "node_seq", F.lit(1).alias("rank")))
    return queries.select(F.col("query")).distinct().join(keys, F.col("query") == F.col("key")).groupBy("query").agg(F.min_by("id", F.struct("rank", "node_seq")).alias("id"))


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """start_id, id, name, depth, via_edge_type, path: what each start (start_id) is reached from, at most max_depth steps back.

    Each symbol comes once, at its least depth, by the edge a breadth-first search finds first: the one of the least path of edge_seq.
    Paths compare as the search's queue does, so that no level needs a global order. Starts are not in the result.
    """
    names = nodes.groupBy(F.col("id").alias("of")).agg(F.min_by("name", "node_seq").alias("name"))
    back = edges.where(F.col("type").isin(*IMPACT_TYPES) & (F.col("source") != "") & (F.col("target") != "")).select("edge_seq", "source", "target", "type")
    known = starts.select("start_id").distinct().join(nodes.select(F.col("id").alias("start_id")).distinct(), "start_id", "left_semi")
    frontier = known.select("start_id", F.col("start_id").alias("id"), F.array().cast("array<bigint>").alias("path"))
    seen = frontier.select("start_id", "id")
    found = frontier.select("start_id", "id", F.lit(0).alias("depth"), F.lit("").alias("via_edge_type"), "path").where(F.lit(False))
    for depth in range(1, max_depth + 1):
        step = frontier.join(back, F.col("id") == F.col("target")).select("start_id", F.col("source").alias("id"), F.concat("path", F.array("edge_seq")).alias("path"), "type")
        first = step.groupBy("start_id", "id").agg(F.min(F.struct("path", "type")).alias("first"))
        frontier = cut(first.join(seen, ["start_id", "id"], "left_anti").select("start_id", "id", "first.path", F.col("first.type").alias("via_edge_type")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.select("start_id", "id", F.lit(depth).alias("depth"), "via_edge_type", "path"))
        seen = seen.unionByName(frontier.select("start_id", "id"))
    return found.join(names, F.col("id") == F.col("of"), "left").select("start_id", "id", F.coalesce("name", "id").alias("name"), "depth", "via_edge_type", "path")


def impact_by_depth(found: DataFrame) -> DataFrame:
    return found.groupBy("start_id", "depth").agg(F.count(F.lit(1)).alias("n"))


def row_digest(*columns: str) -> Column:
    """Five numbers of 48 bits of a row's digest."""
    digest = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])), 256)
    return F.struct(*[F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("long").alias(f"d{i}") for i in range(5)])


def _sum48(number: Column) -> Column:
    """The sum of numbers of 48 bits, as a decimal: their halves are summed as longs, which have room for 2^39 rows and cost less than decimals."""
    high, low = F.sum(F.shiftright(number, 24)), F.sum(number.bitwiseAND(0xFFFFFF))
    return (high.cast("decimal(38,0)") * F.lit(1 << 24) + low.cast("decimal(38,0)")).cast("decimal(38,0)")


_SUMS = [f"s{i}" for i in range(5)]
#: What a row of each kind counts with.
_DIGESTED = {"node": ("id", "name", "kind", "module", "file_path"), "edge": ("source", "target", "type"), "pattern": ("pattern", "symbol_id", "evidence")}


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[_sum48(F.col(f"d.d{i}")).alias(c) for i, c in enumerate(_SUMS)])


def file_digests(nodes: DataFrame, edges: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """file_path, t (node, edge, pattern), n, s0 to s4: sums of the digests of each file's rows, equal rows of it counted.

    Line numbers and docstrings do not count. An edge and a pattern belong to the file of their symbol, the first of its id; to none if the symbol is none. Sums of
    files add up, so a graph of which some files changed needs the sums of these alone.
    """
    of = nodes.groupBy(F.col("id").alias("of")).agg(F.min_by("file_path", "node_seq").alias("file_path"))
    placed = lambda rows, symbol: rows.join(of, F.col(symbol) == F.col("of"), "left")
    held = {"node": nodes, "edge": placed(edges, "source")} | ({} if patterns is None else {"pattern": placed(patterns, "symbol_id")})
    return _summed(reduce(DataFrame.unionByName, [rows.select("file_path", F.lit(t).alias("t"), row_digest(*_DIGESTED[t]).alias("d")) for t, rows in held.items()]), "file_path", "t")


def digest_totals(nodes: DataFrame | None = None, edges: DataFrame | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """t, n, s0 to s4: the sums of file_digests() over all files, of the tables that are given (one at least). No row needs its file for that."""
    held = {"node": nodes, "edge": edges, "pattern": patterns}
    return _summed(reduce(DataFrame.unionByName, [rows.select(F.lit(t).alias("t"), row_digest(*_DIGESTED[t]).alias("d")) for t, rows in held.items() if rows is not None]), "t")


def replaced(digests: DataFrame, gone: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """t, n, s0 to s4 of a graph with these sums, without the rows of gone, which are among its own, and with those of new (sums, too)."""
    parts = [digests.select("t", "n", *_SUMS), gone.select("t", *[(-F.col(c)).alias(c) for c in ("n", *_SUMS)])] + ([] if new is None else [new.select("t", "n", *_SUMS)])
    return reduce(DataFrame.unionByName, parts).groupBy("t").agg(*[F.sum(c).alias(c) for c in ("n", *_SUMS)]).where("n <> 0")


def digests_fingerprint(digests: DataFrame, root: str = "", key: str = "") -> DataFrame:
    """One row: fingerprint of the graph whose files have these digests (or with these totals), of its project's root and of a key (the model that is asked)."""
    sums = digests.groupBy("t").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(5)])
    said = sums.select(F.concat_ws("|", "t", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(5)]).alias("said"))
    head = F.to_json(F.struct(F.lit(root).alias("root"), F.lit(key).alias("key")))
    return said.agg(F.sha2(F.concat_ws("\n", head, F.sort_array(F.collect_list("said"))), 256).alias("fingerprint"))


def fingerprint(nodes: DataFrame, edges: DataFrame, patterns: DataFrame | None = None, root: str = "", key: str = "") -> DataFrame:
    """One row: fingerprint of the graph, whatever the order of its rows; line numbers and docstrings do not count.

    Each row's digest is cut into five numbers, and their sums over all rows (equal rows counted) are hashed.
    """
    return digests_fingerprint(digest_totals(nodes, edges, patterns), root, key)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_path of the files whose digests differ, are new or are gone."""
    both = [d.select("file_path", F.struct("t", "n", *[f"s{i}" for i in range(5)]).alias("d")).groupBy("file_path").agg(F.sort_array(F.collect_list("d")).alias(name)) for d, name in ((before, "a"), (after, "b"))]  # three rows a file at most
    one, two = both[0], both[1].withColumnRenamed("file_path", "other")
    return one.join(two, F.col("file_path").eqNullSafe(F.col("other")), "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.coalesce("file_path", "other").alias("file_path"))


def containment(nodes: DataFrame) -> DataFrame:
    """file_path, depth, id, parent_id, place (array of node_seq from the module down): the explorer's tree, in order of place."""
    top = nodes.where("parent_id IS NULL").select("id", "parent_id", "file_path", "kind", F.array("node_seq").alias("place"))
    level, out = top, top
    for _ in range(2):
        below = nodes.where("parent_id IS NOT NULL").select("id", "parent_id", "file_path", "kind", "node_seq")
        above = level.select(F.col("id").alias("above"), F.col("place").alias("above_place"))
        level = below.join(above, F.col("parent_id") == F.col("above")).select("id", "parent_id", "file_path", "kind", F.concat("above_place", F.array("node_seq")).alias("place"))
        out = out.unionByName(level)
    return out.withColumn("depth", F.size("place"))
