"""Checks a clustering from outside against the graph: invented symbols go, forgotten ones come back."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import numbered, ordinals
from ..functions.text import snippet
from ..sources.keyed import KeyedTable
from .graph import edge_type_histogram, fan_metrics, fingerprint

#: What strip() removes at both ends of a text.
_WHITE = r"^[\s\x1C-\x1F\x{85}\p{Z}]+|[\s\x1C-\x1F\x{85}\p{Z}]+$"
FIELDS = ("component_id", "name", "member_symbol_ids", "role", "rationale")
_FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"


class MalformedClustering(ValueError):
    """A reply that is no clustering."""


def json_object(text: Column) -> Column:
    """The JSON object in a reply, as VARIANT: the whole text, else the first fenced block, else from the first brace to the last; null if none is an object."""
    raw = F.trim(text)
    first, last = F.instr(raw, F.lit("{")), F.length(raw) - F.instr(F.reverse(raw), F.lit("}")) + 1
    braces = F.when((first > 0) & (F.instr(raw, F.lit("}")) > 0) & (last > first), F.substring(raw, first, last - first + 1))

    def as_object(candidate: Column) -> Column:
        parsed = F.try_parse_json(candidate)
        return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)

    return F.coalesce(as_object(raw), as_object(F.regexp_extract(raw, _FENCE, 1)), as_object(braces))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _WHITE, "")


def problems(clusterings: DataFrame) -> DataFrame:
    """clustering_id, problem of replies (clustering_id, reply) that are no clusterings."""
    rows = clusterings.withColumn("v", json_object(F.col("reply")))
    parts = rows.where("v IS NOT NULL").select("clustering_id", F.posexplode_outer(F.try_variant_get("v", "$.components", "array<variant>")).alias("at", "c"))
    is_object = F.schema_of_variant("c").startswith("OBJECT")
    missing = F.array_compact(F.array(*[F.when(F.try_variant_get("c", f"$.{f}", "variant").isNull(), F.lit(f)) for f in FIELDS]))
    bad = F.when(~is_object, F.concat(F.lit("component "), F.col("at"), F.lit(" is not an object")))
    bad = bad.when(F.size(missing) > 0, F.concat(F.lit("component "), F.col("at"), F.lit(" lacks "), F.array_join(missing, ", ")))
    bad = bad.when(~_kind(F.col("c"), "$.member_symbol_ids").startswith("ARRAY"), F.concat(F.lit("component "), F.col("at"), F.lit(" has no list of members")))
    inner = parts.where("c IS NOT NULL").select("clustering_id", bad.alias("problem"))
    top = F.when(F.col("v").isNull(), "no JSON object").when(~F.coalesce(_kind(F.col("v"), "$.components").startswith("ARRAY"), F.lit(False)), "no list of components").when(F.coalesce(_kind(F.col("v"), "$.narrative"), F.lit("")) != "STRING", "no narrative")
    return rows.select("clustering_id", top.alias("problem")).unionByName(inner).where("problem IS NOT NULL")


def members(clusterings: DataFrame) -> DataFrame:
    """clustering_id, at, component_id, name, role, rationale, member_at, symbol_id of each named member; a component without members has one row with null."""
    rows = clusterings.withColumn("v", json_object(F.col("reply"))).where("v IS NOT NULL")
    parts = rows.select("clustering_id", F.posexplode(F.try_variant_get("v", "$.components", "array<variant>")).alias("at", "c"))
    text = lambda f: _strip(F.try_variant_get("c", f"$.{f}", "string"))
    named = F.when(F.coalesce(text("component_id"), F.lit("")) == "", F.concat(F.lit("comp_"), F.col("at") + 1)).otherwise(text("component_id"))
    parts = parts.select("clustering_id", "at", named.alias("component_id"), *[text(f).alias(f) for f in ("name", "role", "rationale")], F.try_variant_get("c", "$.member_symbol_ids", "array<string>").alias("m"))
    return parts.select("clustering_id", "at", "component_id", "name", "role", "rationale", F.posexplode_outer("m").alias("member_at", "s")).withColumn("symbol_id", _strip(F.col("s"))).drop("s")


def listed_unclustered(clusterings: DataFrame) -> DataFrame:
    """clustering_id, member_at, symbol_id of the symbols that a reply lists as unclustered."""
    rows = clusterings.withColumn("v", json_object(F.col("reply"))).where("v IS NOT NULL")
    return rows.select("clustering_id", F.posexplode(F.try_variant_get("v", "$.unclustered_symbol_ids", "array<string>")).alias("member_at", "s")).select("clustering_id", "member_at", _strip(F.col("s")).alias("symbol_id"))


def valid_members(clusterings: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members that are symbols of the graph."""
    return members(clusterings).where("symbol_id IS NOT NULL").join(nodes.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_semi")


def dropped(clusterings: DataFrame, nodes: DataFrame) -> DataFrame:
    """clustering_id, part (0 components, 1 the unclustered list), at, member_at, symbol_id of symbols that the graph lacks, in the order of the report."""
    named = members(clusterings).where("symbol_id IS NOT NULL").select("clustering_id", F.lit(0).alias("part"), "at", "member_at", "symbol_id")
    listed = listed_unclustered(clusterings).select("clustering_id", F.lit(1).alias("part"), F.lit(0).alias("at"), "member_at", "symbol_id")
    return named.unionByName(listed).join(nodes.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_anti")


#: Ranks that a row of gaps is dealt out in.
_STRETCH = 10_000


def _ranked_members(clusterings: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol_id, rank of the graph's symbols in order of id; clustering_id, rank, at: the members of each clustering, numbered in that order)."""
    ranks = numbered(nodes.select(F.col("id").alias("symbol_id")).distinct(), [F.col("symbol_id")], "rank")
    held = valid_members(clusterings, nodes).select("clustering_id", "symbol_id").distinct().join(ranks, "symbol_id").select("clustering_id", "rank")
    return ranks, ordinals(held, "clustering_id", [F.col("rank")], "at")


def unclustered_counts(clusterings: DataFrame, nodes: DataFrame) -> DataFrame:
    """clustering_id, n, first_id: how many of the graph's symbols are in no component, and the least id of these; null if all are in one.

    n is the number of symbols less that of members. Members in order of rank have the ranks 0, 1, 2, ... up to the first gap, which is the first symbol that is
    missing. Work grows with symbols and members, not with their product over clusterings.
    """
    ranks, held = _ranked_members(clusterings, nodes)
    total = ranks.count()
    seen = held.groupBy("clustering_id").agg(F.count(F.lit(1)).alias("members"), F.min(F.when(F.col("rank") != F.col("at"), F.col("at"))).alias("gap"))
    every = clusterings.select("clustering_id").distinct().join(seen, "clustering_id", "left").withColumn("members", F.coalesce("members", F.lit(0)))
    missing = every.select("clustering_id", (F.lit(total) - F.col("members")).cast("long").alias("n"), F.coalesce("gap", "members").alias("first"))
    return missing.join(ranks, F.col("first") == F.col("rank"), "left").select("clustering_id", "n", F.col("symbol_id").alias("first_id"))


def unclustered(clusterings: DataFrame, nodes: DataFrame) -> DataFrame:
    """clustering_id, symbol_id of the graph's symbols in no component: the gaps between the ranks of members, dealt out in stretches. Only the rows of the result are made."""
    ranks, held = _ranked_members(clusterings, nodes)
    total = ranks.count()
    every = clusterings.select("clustering_id").distinct()
    # before each member, and after the last one or where there is none
    ends = held.select("clustering_id", "at", F.col("rank").alias("stop")).unionByName(every.join(held.groupBy("clustering_id").agg(F.count(F.lit(1)).alias("at")), "clustering_id", "left").select("clustering_id", F.coalesce("at", F.lit(0)).cast("long").alias("at"), F.lit(total).cast("long").alias("stop")))
    before = held.select("clustering_id", (F.col("at") + 1).alias("at"), (F.col("rank") + 1).alias("start"))
    gaps = ends.join(before, ["clustering_id", "at"], "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long"))).where("start < stop")
    stretches = gaps.select("clustering_id", "stop", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(_STRETCH).cast("long"))).alias("start"))
    dealt = stretches.repartition("clustering_id", "start").select("clustering_id", F.explode(F.sequence("start", F.least(F.col("start") + _STRETCH, "stop") - 1)).alias("rank"))
    return dealt.join(ranks, "rank").select("clustering_id", "symbol_id")


def components(clusterings: DataFrame, nodes: DataFrame) -> DataFrame:
    """clustering_id, at, component_id, name, role, rationale, n_members: all components, empty ones too."""
    found = valid_members(clusterings, nodes).groupBy("clustering_id", "at").agg(F.count(F.lit(1)).alias("n"))
    every = members(clusterings).select("clustering_id", "at", "component_id", "name", "role", "rationale").distinct()
    return every.join(found, ["clustering_id", "at"], "left").withColumn("n_members", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def prompt(nodes: DataFrame, edges: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """part, seq, line: the lines of a request for a clustering. 0: counts by kind; 1: symbols with name, module, file and metrics; 2: every edge; 3: patterns; 4: edge types. Not gathered: a caller reads them in order."""
    metrics = fan_metrics(nodes, edges)
    line = lambda part, seq, text: [F.lit(part).alias("part"), seq.cast("long").alias("seq"), text.alias("line")]
    counts = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("node_seq").alias("first")).select(*line(0, F.col("first"), F.format_string("%d %s", "n", "kind")))
    said = F.format_string("- %s (%s) name=%s module=%s file=%s fan_in=%d fan_out=%d instability=%s %s", "id", "kind", "name", "module", "file_path", "fan_in", "fan_out", F.col("instability").cast("string"), F.coalesce(snippet(F.col("docstring")), F.lit("")))
    out = counts.unionByName(nodes.join(metrics, "id").select(*line(1, F.col("node_seq"), said)))
    out = out.unionByName(edges.select(*line(2, F.col("edge_seq"), F.format_string("%s -> %s [%s]", "source", "target", "type"))))
    if patterns is not None:
        out = out.unionByName(patterns.select(*line(3, F.xxhash64("symbol_id", "pattern"), F.format_string("%s: %s", "pattern", "symbol_id"))))
    return out.unionByName(edge_type_histogram(edges).select(*line(4, F.col("first_seq"), F.format_string("%s: %d", "type", "n"))))


class ClusteringCache:
    """Replies by the fingerprint of graph, root and model: in the driver's memory, and in a table where a folder is given, so that they outlive the driver."""

    SCHEMA = "key string, reply string"

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None, buckets: int = 16):
        self.held: dict[str, str] = {}
        self.table = KeyedTable(spark, folder, self.SCHEMA, "key", buckets) if folder else None

    def get(self, key: str) -> str | None:
        if key not in self.held and self.table is not None:
            for row in self.table.load(tolerant=True).where(F.col("key") == key).collect():  # one row at most
                self.held[key] = row.reply
        return self.held.get(key)

    def put(self, key: str, reply: str) -> None:
        self.held[key] = reply
        if self.table is not None:
            self.table.update(self.table.spark.createDataFrame([(key, reply)], self.SCHEMA), tolerant=True)

    def clear(self) -> None:
        self.held.clear()
        if self.table is not None:
            self.table.clear()

    def __len__(self) -> int:
        return len(self.held) if self.table is None else self.table.load(tolerant=True).count()


def _asked(spark: SparkSession, ask: Callable[[str, str], str], text: str) -> str:
    """A reply that is a clustering; a malformed one is asked for once more, more strictly."""
    problem = ""
    for system in ("Group these symbols into components. Answer with one JSON object.", "Answer with one JSON object only, with components, unclustered_symbol_ids and narrative."):
        reply = ask(system, text + (f"\nThe last answer was rejected: {problem}" if problem else ""))
        if reply.startswith("[Error]"):
            raise RuntimeError(reply)
        found = problems(spark.createDataFrame([(0, reply)], "clustering_id int, reply string")).select("problem").first()
        if found is None:
            return reply
        problem = found.problem
    raise MalformedClustering(problem)


def _united(spark: SparkSession, replies: list[str]) -> str:
    """One clustering of the replies to the parts of a request."""
    rows = spark.createDataFrame(list(enumerate(replies)), "n int, reply string").select("n", F.to_json(json_object(F.col("reply"))).alias("o")).orderBy("n").collect()
    parts = [json.loads(r.o) for r in rows]
    return json.dumps({"components": [c for p in parts for c in p["components"]], "unclustered_symbol_ids": [x for p in parts for x in p.get("unclustered_symbol_ids") or []], "narrative": "\n".join(str(p["narrative"]) for p in parts)})


def cluster(
    spark: SparkSession, nodes: DataFrame, edges: DataFrame, ask: Callable[[str, str], str], cache: ClusteringCache, model: str = "", refresh: bool = False, most_lines: int = 2000, patterns: DataFrame | None = None, root: str = ""
) -> DataFrame:
    """A reply (clustering_id, reply) that is a clustering: from the cache, or from ask(system, prompt).

    All lines of the prompt are sent, most_lines at a time; the driver holds one part. The replies to several parts become one. An empty graph has
    a fixed reply.
    """
    key = fingerprint(nodes, edges, patterns, root, model).first()[0]
    reply = None if refresh else cache.get(key)
    if reply is None:
        if nodes.isEmpty():
            reply = '{"components": [], "unclustered_symbol_ids": [], "narrative": "The graph has no symbols."}'
        else:
            lines = (r.line for r in prompt(nodes, edges, patterns).orderBy("part", "seq").toLocalIterator())
            replies = [_asked(spark, ask, "\n".join(part)) for part in iter(lambda: list(islice(lines, most_lines)), [])]
            reply = replies[0] if len(replies) == 1 else _united(spark, replies)
        cache.put(key, reply)
    return spark.createDataFrame([(0, reply)], "clustering_id int, reply string")
