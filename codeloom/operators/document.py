"""The graph as one JSON document, and what a chat is told of a symbol: as rows of text in order, never gathered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_slice
from .graph import edge_type_histogram, fan_metrics, lookup, neighbours, summary

_NODE = ("id", "name", "kind", "module", "file_path", "lineno", "end_lineno", "parent_id", "docstring")
_ALL = {"ignoreNullFields": "false"}


def graph_json(nodes: DataFrame, edges: DataFrame, errors: DataFrame | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """section, seq, json: a JSON object for each node, edge, parse error and pattern, in their order, and one for the summary.

    Columns that are null are null in the JSON. An empty table has no rows in its section.
    """
    json = lambda *c: F.to_json(F.struct(*c), _ALL).alias("json")
    out = [nodes.select(F.lit("nodes").alias("section"), F.col("node_seq").alias("seq"), json(*_NODE)), edges.select(F.lit("edges").alias("section"), F.col("edge_seq").alias("seq"), json("source", "target", "type"))]
    if errors is not None:
        out.append(errors.select(F.lit("errors").alias("section"), F.xxhash64("file_path").alias("seq"), json("file_path", "message")))
    if patterns is not None:
        out.append(patterns.select(F.lit("patterns").alias("section"), F.xxhash64("symbol_id", "pattern").alias("seq"), json("pattern", "symbol_id", "evidence")))
    counts = summary(nodes, edges)
    out.append(counts.select(F.lit("summary").alias("section"), F.lit(0).cast("long").alias("seq"), json(*counts.columns)))
    return reduce(DataFrame.unionByName, out)


def json_lines(rows: DataFrame) -> DataFrame:
    """value: the lines of one JSON document with a list per section of graph_json(), in global order; written as text, the files in order of name are the document."""
    sections = ("nodes", "edges", "errors", "patterns", "summary")
    place = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    first = rows.groupBy("section").agg(F.min(F.struct("seq", "json")).alias("first"))  # a row per section
    body = rows.join(F.broadcast(first), "section").select(place.alias("place"), F.lit(1).alias("part"), "seq", F.concat(F.when(F.struct("seq", "json") == F.col("first"), "").otherwise(","), "json").alias("value"))
    marks = [(i + 1, part, ("{" if i == 0 else ",") + f'"{s}":[' if part == 0 else "]" + ("}" if i == len(sections) - 1 else "")) for i, s in enumerate(sections) for part in (0, 2)]
    frame = rows.sparkSession.createDataFrame([(p, q, 0, v) for p, q, v in marks], "place long, part int, seq long, value string")
    return body.unionByName(frame).orderBy("place", "part", "seq", "value").select("value")


def _line(part: int, seq: Column, line: Column) -> list[Column]:
    return [F.lit(part).alias("part"), seq.cast("long").alias("seq"), line.alias("line")]


def chat_context(nodes: DataFrame, edges: DataFrame, query: str, files: DataFrame | None = None) -> DataFrame:
    """part, seq, line: what a chat about a symbol is told. Part 0 is the symbol, 1 what points to it, 2 what it points to, 3 the counts of
    the graph and of each type of edge, 4 its source lines from files (rel_file_path, content). A line per neighbour: a hot symbol is not gathered.

    A symbol that lookup does not find leaves the counts alone; a file that is not there leaves the source out.
    """
    one = lookup(nodes, query)
    said = one.join(fan_metrics(one.select("id"), edges), "id")
    where = F.concat(F.col("file_path"), F.lit(":"), F.col("lineno").cast("string"), F.lit("-"), F.col("end_lineno").cast("string"))
    facts = (("symbol", "name"), ("kind", "kind"), ("docstring", "docstring"), ("fan-in", "fan_in"), ("fan-out", "fan_out"))
    lines = F.array(*[F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for label, c in facts], F.concat(F.lit("place: "), F.coalesce(where, F.lit("none"))))
    out = [said.select(F.posexplode(lines).alias("seq", "line")).select(*_line(0, F.col("seq"), F.col("line")))]
    ends = edges.join(F.broadcast(one.select("id")), (F.col("source") == F.col("id")) | (F.col("target") == F.col("id")), "left_semi")
    near = neighbours(nodes, ends).join(F.broadcast(one.select("id")), "id", "left_semi")
    for part, side in ((1, "incoming"), (2, "outgoing")):
        out.append(near.where(F.col("direction") == side).select(*_line(part, F.col("edge_seq"), F.concat("neighbour_name", F.lit(" ["), "type", F.lit("]")))))
    counts = summary(nodes, edges)
    out.append(counts.select(*_line(3, F.lit(0), F.concat_ws(", ", *[F.concat(F.col(c).cast("string"), F.lit(f" {c.replace('total_', '').replace('_count', '')}")) for c in counts.columns if not c.startswith("cache")]))))
    out.append(edge_type_histogram(edges).select(*_line(3, F.col("first_seq") + 1, F.concat(F.col("n").cast("string"), F.lit(" "), "type"))))
    if files is not None:
        held = files.join(F.broadcast(one.select("file_path", "lineno", "end_lineno")), F.col("rel_file_path") == F.col("file_path"))
        source = line_slice(held, "content", F.col("lineno"), F.col("end_lineno")).select(F.posexplode("lines").alias("seq", "line"))
        out.append(source.select(*_line(4, F.col("seq"), F.col("line"))))
    return reduce(DataFrame.unionByName, out)
