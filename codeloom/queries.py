"""The catalogue of queries over the driver's tables, each with DuckDB SQL that says the same of the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import highlight
from .functions import text as fn
from .functions.order import numbered
from .operators import document, extract, graph, patterns, reconcile, registry, resolve, survey, views
from .plans import star
from .runtime import cut, shared_folder
from .sources import cache, scan
from .sources.survey import read_answers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TIES = "[" + ", ".join(repr(round(m / 200, 2)) for m in range(201)) + "]"
_ROUND = f"CASE WHEN fi + fo = 0 THEN 0.0::DOUBLE WHEN 200 * fo % (fi + fo) = 0 THEN {_TIES}[(200 * fo // (fi + fo))::INT + 1]::DOUBLE ELSE ((200 * fo + fi + fo) // (2 * (fi + fo)))::DOUBLE / 100 END"
_STAR = """
place AS (SELECT n_nationkey AS k, 'R' || n_regionkey || '.N' || n_nationkey AS nid, 'R' || n_regionkey AS rid FROM nation),
nodes AS (
 SELECT 0::BIGINT + r_regionkey AS node_seq, 'R' || r_regionkey AS id, r_name AS name, 'module' AS kind, 'R' || r_regionkey AS module, NULL::VARCHAR AS parent_id, 1::BIGINT AS line FROM region
 UNION ALL SELECT 1000000000000000000 + n_nationkey, nid, n_name, 'class', rid, rid, n_nationkey * 10 + 1 FROM nation JOIN place ON k = n_nationkey
 UNION ALL SELECT 2000000000000000000 + s_suppkey, nid || '.S' || s_suppkey, s_name, 'method', rid, nid, s_suppkey FROM supplier JOIN place ON k = s_nationkey
 UNION ALL SELECT 3000000000000000000 + c_custkey, nid || '.C' || c_custkey, c_name, 'method', rid, nid, c_custkey FROM customer JOIN place ON k = c_nationkey
 UNION ALL SELECT 4000000000000000000 + p_partkey, 'P.' || p_partkey, p_name, 'function', 'P', NULL, p_partkey FROM part
 UNION ALL SELECT 5000000000000000000 + o_orderkey, 'O.' || o_orderkey, 'order ' || o_orderkey, 'function', 'O', NULL, o_orderkey FROM orders),
sup AS (SELECT s_suppkey, nid, nid || '.S' || s_suppkey AS sid FROM supplier JOIN place ON k = s_nationkey),
cus AS (SELECT c_custkey, nid, nid || '.C' || c_custkey AS cid FROM customer JOIN place ON k = c_nationkey),
all_edges AS (
 SELECT 1000000000000000000 + n_nationkey AS edge_seq, rid AS source, nid AS target, 'defines' AS type FROM nation JOIN place ON k = n_nationkey
 UNION ALL SELECT 2000000000000000000 + s_suppkey, nid, sid, 'defines' FROM sup
 UNION ALL SELECT 3000000000000000000 + c_custkey, nid, cid, 'defines' FROM cus
 UNION ALL SELECT 4000000000000000000 + l_orderkey * 8 + l_linenumber, 'O.' || l_orderkey, 'P.' || l_partkey, 'calls' FROM lineitem
 UNION ALL SELECT 5000000000000000000 + l_orderkey * 8 + l_linenumber, 'P.' || l_partkey, sid, 'constructs' FROM lineitem JOIN sup ON l_suppkey = s_suppkey
 UNION ALL SELECT 6000000000000000000 + o_orderkey, cid, 'O.' || o_orderkey, 'inherits' FROM orders JOIN cus ON o_custkey = c_custkey),
edges AS (SELECT min(edge_seq) AS edge_seq, source, target, type FROM all_edges GROUP BY source, target, type)"""


def query(sql: str | None = None, star_sql: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {_STAR}{sql if sql.lstrip().startswith(',') else chr(10) + sql}" if star_sql else sql
        return f

    return add


def _graph(spark, sf_dir):
    return star.star_nodes(spark, sf_dir), star.star_edges(spark, sf_dir)


# --- metrics and lookups -------------------------------------------------------------------------------------------------
@query(f"""SELECT id, fi::BIGINT AS fan_in, fo::BIGINT AS fan_out, {_ROUND} AS instability FROM (
 SELECT n.id, coalesce(i.c, 0) AS fi, coalesce(o.c, 0) AS fo FROM (SELECT DISTINCT id FROM nodes) n
 LEFT JOIN (SELECT target, count(*) AS c FROM edges GROUP BY 1) i ON n.id = i.target LEFT JOIN (SELECT source, count(*) AS c FROM edges GROUP BY 1) o ON n.id = o.source)""", True)  # fmt: skip
def fan_metrics(spark, sf_dir):
    return graph.fan_metrics(*_graph(spark, sf_dir))


@query("""SELECT count(*) AS total_nodes, count(*) FILTER (kind = 'module') AS module_count, count(*) FILTER (kind = 'class') AS class_count, count(*) FILTER (kind = 'function') AS function_count,
 count(*) FILTER (kind = 'method') AS method_count, (SELECT count(*) FROM edges) AS total_edges, 0::BIGINT AS cache_hits, 0::BIGINT AS cache_misses FROM nodes""", True)  # fmt: skip
def graph_summary(spark, sf_dir):
    return graph.summary(*_graph(spark, sf_dir))


@query("SELECT type, count(*) AS n, min(edge_seq) AS first_seq FROM edges GROUP BY type", True)
def edge_type_hist(spark, sf_dir):
    return graph.edge_type_histogram(star.star_edges(spark, sf_dir))


@query("SELECT edge_seq, source, target, type FROM edges", True)
def edge_dedupe(spark, sf_dir):
    return graph.dedupe_edges(star.star_edges(spark, sf_dir, distinct=False))


@query("""SELECT e.target AS id, 'incoming' AS direction, edge_seq, e.source AS neighbour_id, coalesce(n.name, e.source) AS neighbour_name, type FROM edges e LEFT JOIN nodes n ON n.id = e.source
 UNION ALL SELECT e.source, 'outgoing', edge_seq, e.target, coalesce(n.name, e.target), type FROM edges e LEFT JOIN nodes n ON n.id = e.target""", True)  # fmt: skip
def symbol_neighbours(spark, sf_dir):
    return graph.neighbours(*_graph(spark, sf_dir))


@query(f""", one AS (SELECT * FROM nodes WHERE id = 'R1.N1' OR name = 'R1.N1' OR suffix(id, '.R1.N1') ORDER BY (id <> 'R1.N1'), node_seq LIMIT 1)
SELECT id, name, kind, module || '.py' AS file_path, line::INT AS lineno, (line + 4)::INT AS end_lineno, NULL::VARCHAR AS docstring, fi::BIGINT AS fan_in, fo::BIGINT AS fan_out, {_ROUND} AS instability
FROM (SELECT one.*, (SELECT count(*) FROM edges WHERE target = one.id) AS fi, (SELECT count(*) FROM edges WHERE source = one.id) AS fo FROM one)""", True)  # fmt: skip
def symbol_detail(spark, sf_dir):
    return graph.symbol_detail(*_graph(spark, sf_dir), "R1.N1")


@query(""", asked AS (SELECT name AS query FROM nodes UNION SELECT split_part(id, '.', -1) FROM nodes UNION SELECT id FROM nodes UNION SELECT 'nothing'),
keys AS (SELECT id AS key, id, node_seq, 0 AS r FROM nodes UNION ALL SELECT name, id, node_seq, 1 FROM nodes UNION ALL SELECT split_part(id, '.', -1), id, node_seq, 1 FROM nodes WHERE contains(id, '.')
 UNION ALL SELECT split_part(id, '.', -2) || '.' || split_part(id, '.', -1), id, node_seq, 1 FROM nodes WHERE len(id) - len(replace(id, '.', '')) = 2)
SELECT query, arg_min(id, (r, node_seq)) AS id FROM asked JOIN keys ON query = key GROUP BY query""", True)  # fmt: skip
def symbol_lookup(spark, sf_dir):
    nodes = star.star_nodes(spark, sf_dir)
    asked = nodes.select(F.col("name").alias("query")).unionByName(nodes.select(fn.short_name(F.col("id")).alias("query"))).unionByName(nodes.select(F.col("id").alias("query"))).unionByName(spark.createDataFrame([("nothing",)], "query string"))
    return graph.lookup_all(nodes, asked)


@query("SELECT node_seq, id, name, kind FROM nodes WHERE id = 'S3' OR name = 'S3' OR suffix(id, 'S3') ORDER BY node_seq LIMIT 1", True)
def view_lookup(spark, sf_dir):
    return graph.view_lookup(star.star_nodes(spark, sf_dir), "S3").select("node_seq", "id", "name", "kind")


@query(""", asked AS (SELECT right(s_name, (s_suppkey % 9 + 1)::INT) AS query FROM supplier UNION SELECT 'S' || s_suppkey FROM supplier UNION SELECT n_name FROM nation UNION SELECT 'N' || n_nationkey || '.S' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'none such')
SELECT query, arg_min(id, node_seq) AS id FROM asked JOIN nodes ON id = query OR name = query OR suffix(id, query) GROUP BY query""", True)  # fmt: skip
def view_lookup_all(spark, sf_dir):
    """What a click on each of many texts shows: ends of suppliers' names, ends of ids with and without a dot, names of nations."""
    supplier, nation = star.read(spark, sf_dir, "supplier", "nation")
    text = lambda c: F.col(c).cast("string")
    asked = supplier.select(F.right("s_name", (F.col("s_suppkey") % 9 + 1).cast("int")).alias("query")).unionByName(supplier.select(F.concat(F.lit("S"), text("s_suppkey")).alias("query"))).unionByName(nation.select(F.col("n_name").alias("query")))
    asked = asked.unionByName(supplier.select(F.concat(F.lit("N"), text("s_nationkey"), F.lit(".S"), text("s_suppkey")).alias("query"))).unionByName(spark.createDataFrame([("none such",)], "query string"))
    return graph.view_lookup_all(star.star_nodes(spark, sf_dir), asked)


# --- change impact ---------------------------------------------------------------------------------------------------------
_IMPACT = """, f AS (SELECT s.id AS start_id, s.id, 0 AS depth, []::BIGINT[] AS path, '' AS via FROM start s
 UNION ALL SELECT start_id, source, depth + 1, list_append(path, edge_seq), type FROM f JOIN edges ON f.id = target WHERE type <> 'defines' AND depth < {depth}),
best AS (SELECT start_id, id, min(depth) AS depth, arg_min(via, path) AS via_edge_type FROM f WHERE depth > 0 GROUP BY start_id, id)
"""


@query(", start AS (SELECT sid AS id FROM sup WHERE s_suppkey = 3)" + _IMPACT.format(depth=3) + "SELECT start_id, b.id, coalesce(n.name, b.id) AS name, depth, via_edge_type FROM best b LEFT JOIN nodes n ON n.id = b.id", True)
def impact_supplier(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    start = nodes.where("id LIKE '%.S3'").select(F.col("id").alias("start_id"))
    return graph.impact(nodes, cut(edges), start).drop("path")


@query(", start AS (SELECT sid AS id FROM sup WHERE s_suppkey = 3)" + _IMPACT.format(depth=3) + "SELECT start_id, depth, count(*) AS n FROM best GROUP BY start_id, depth", True)
def impact_depth_hist(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    start = nodes.where("id LIKE '%.S3'").select(F.col("id").alias("start_id"))
    return graph.impact_by_depth(graph.impact(nodes, cut(edges), start))


@query(", start AS (SELECT sid AS id FROM sup WHERE s_suppkey % 100 = 0)" + _IMPACT.format(depth=3) + "SELECT start_id, depth, count(*) AS n FROM best GROUP BY start_id, depth", True)
def impact_batch(spark, sf_dir):
    """The blast radius of every supplier whose key is divisible by 100, all at once, against the whole graph."""
    nodes, edges = _graph(spark, sf_dir)
    start = nodes.where("try_cast(regexp_extract(id, '[.]S([0-9]+)$', 1) AS BIGINT) % 100 = 0").select(F.col("id").alias("start_id"))
    return graph.impact_by_depth(graph.impact(nodes, cut(edges), start, max_depth=3))


@query("""SELECT module || '.py' AS file_path, CASE WHEN parent_id IS NULL THEN 1 WHEN kind = 'class' THEN 2 ELSE 3 END AS depth, n.id, n.parent_id, n.kind,
 CASE WHEN parent_id IS NULL THEN [node_seq] WHEN kind = 'class' THEN [(SELECT p.node_seq FROM nodes p WHERE p.id = n.parent_id), node_seq]
 ELSE [(SELECT g.node_seq FROM nodes p JOIN nodes g ON g.id = p.parent_id WHERE p.id = n.parent_id), (SELECT p.node_seq FROM nodes p WHERE p.id = n.parent_id), node_seq] END AS place FROM nodes n""", True)  # fmt: skip
def containment_tree(spark, sf_dir):
    return graph.containment(star.star_nodes(spark, sf_dir))


@query("SELECT module || '.py' AS file_path, min(node_seq) AS first_seq, count(*) FILTER (kind = 'module') AS n_module, count(*) FILTER (kind = 'class') AS n_class, count(*) FILTER (kind = 'function') AS n_function, count(*) FILTER (kind = 'method') AS n_method FROM nodes GROUP BY module", True)
def explorer_files(spark, sf_dir):
    return views.explorer(star.star_nodes(spark, sf_dir))


# --- views -----------------------------------------------------------------------------------------------------------------
@query("SELECT id, kind FROM nodes WHERE kind IN ('module', 'class', 'function')", True)
def kind_filter(spark, sf_dir):
    return views.kind_filter(star.star_nodes(spark, sf_dir), {"method": False}).select("id", "kind")


@query("SELECT id, name FROM nodes WHERE contains(lower(name), 'r1') OR contains(lower(id), 'r1')", True)
def text_filter(spark, sf_dir):
    return views.text_filter(star.star_nodes(spark, sf_dir), " R1 ").select("id", "name")


@query(""", hit AS (SELECT * FROM nodes WHERE contains(lower(name), '_1')), up AS (SELECT parent_id AS id FROM hit), up2 AS (SELECT n.parent_id AS id FROM nodes n JOIN up USING (id)),
down AS (SELECT n.id FROM nodes n JOIN hit h ON n.parent_id = h.id WHERE n.kind = 'method' AND h.kind = 'class')
SELECT id, kind, name FROM nodes WHERE id IN (SELECT id FROM hit UNION SELECT id FROM up UNION SELECT id FROM up2 UNION SELECT id FROM down)""", True)  # fmt: skip
def tree_filter(spark, sf_dir):
    return views.tree_filter(star.star_nodes(spark, sf_dir), "_1").select("id", "kind", "name")


@query("SELECT node_seq, coalesce(name, '-') AS name, kind, module, module || '.py' AS file, line::VARCHAR AS start, (line + 4)::VARCHAR AS \"end\" FROM nodes", True)
def table_rows(spark, sf_dir):
    return views.table_rows(star.star_nodes(spark, sf_dir))


@query("SELECT 'e_' || edge_seq || '_' || source || '_' || target || '_' || type AS element_id, source, target, type FROM edges", True)
def edge_elements(spark, sf_dir):
    return views.edge_elements(star.star_edges(spark, sf_dir))


@query("""SELECT p_partkey, p_name, row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all(lower(p_name), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(len(coalesce(nullif(ltrim(x, '0'), ''), '0'))::VARCHAR, 10, '0') || coalesce(nullif(ltrim(x, '0'), ''), '0') ELSE x END), ''), p_partkey) AS place FROM part ORDER BY place LIMIT 100""")
def natural_sort_topn(spark, sf_dir):
    """The first hundred parts in natural order of their names; the limit is the report's."""
    top = views.sorted_table(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node_seq"), "p_name"), "p_name").limit(100)
    ranked = top.withColumn("key", fn.natural_key(F.col("p_name"))).agg(F.array_sort(F.collect_list(F.struct("key", "node_seq", "p_name"))).alias("rows"))
    return ranked.select(F.posexplode("rows").alias("at", "r")).select(F.col("r.node_seq").alias("p_partkey"), "r.p_name", (F.col("at") + 1).cast("long").alias("place"))


@query(r"""SELECT s_suppkey, row_number() OVER (ORDER BY strip_accents(lower(regexp_extract(name, '^[^0-9]*'))), coalesce(try_cast(regexp_extract(name, '[0-9]+') AS BIGINT), -1), s_suppkey % 1000, s_suppkey) - 1 AS place
 FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN translate(n_name, 'SEIOCNZ', 'ŠÉïöçÑž') ELSE n_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")  # fmt: skip
def natural_sort_accents(spark, sf_dir):
    """The place of each supplier by its nation's name, half of them written with accents and in other letters' cases, and a number behind it."""
    nation, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.translate("n_name", "SEIOCNZ", "ŠÉïöçÑž")).otherwise(F.lower("n_name"))
    key = fn.natural_key(F.concat(name, F.lit(" "), (F.col("s_suppkey") % 1000).cast("string")))
    named = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", key.alias("key"))
    return numbered(named, [F.col("key"), F.col("s_suppkey")], "place").select("s_suppkey", "place")


@query()
def graph_fingerprint(spark, sf_dir):
    return graph.fingerprint(*_graph(spark, sf_dir))


@query("SELECT 1::BIGINT AS fingerprints, 64 AS width, 5::BIGINT AS told_apart")
def fingerprint_invariant(spark, sf_dir):
    """The fingerprint of the graph in two orders and partitionings is one. Without an edge type, with another file, other evidence, another root or another model it is another."""
    nodes, edges = _graph(spark, sf_dir)
    found = nodes.where("kind = 'class'").select(F.lit("Observer").alias("pattern"), F.col("id").alias("symbol_id"), F.lit("loops").alias("evidence"))
    digests = cut(graph.file_digests(nodes, edges, found))
    same = graph.digests_fingerprint(digests).unionByName(graph.fingerprint(nodes.repartition("name"), edges.repartition("target"), found.repartition(3)))
    # sums add up, so another graph needs those of what differs alone
    first = nodes.where("id = 'R1'")
    totals = graph.digest_totals
    bare = graph.replaced(digests, totals(edges=edges.where("type = 'inherits'")))
    moved = graph.replaced(digests, totals(first), totals(first.withColumn("file_path", F.lit("other.py"))))
    said = graph.replaced(digests, totals(patterns=found), totals(patterns=found.withColumn("evidence", F.lit("else"))))
    others = graph.digests_fingerprint(bare).unionByName(graph.digests_fingerprint(moved)).unionByName(graph.digests_fingerprint(said))
    others = others.unionByName(graph.digests_fingerprint(digests, root="/other")).unionByName(graph.digests_fingerprint(digests, key="model")).select(F.col("fingerprint").alias("other"))
    one = same.agg(F.count_distinct("fingerprint").alias("fingerprints"), F.max(F.length("fingerprint")).alias("width"), F.max("fingerprint").alias("fingerprint"))
    told = one.crossJoin(others).where("fingerprint <> other")  # one row by five
    return told.groupBy("fingerprints", "width").agg(F.count_distinct("other").alias("told_apart"))


# --- the graph as a document, and what a chat is told ------------------------------------------------------------------------
@query("""SELECT 'nodes' AS section, node_seq AS seq, to_json({'id': id, 'name': name, 'kind': kind, 'module': module, 'file_path': module || '.py', 'lineno': line::INT, 'end_lineno': (line + 4)::INT, 'parent_id': parent_id, 'docstring': NULL::VARCHAR})::VARCHAR AS json FROM nodes
 UNION ALL SELECT 'edges', edge_seq, to_json({'source': source, 'target': target, 'type': type})::VARCHAR FROM edges
 UNION ALL SELECT 'summary', 0, to_json({'total_nodes': count(*), 'module_count': count(*) FILTER (kind = 'module'), 'class_count': count(*) FILTER (kind = 'class'), 'function_count': count(*) FILTER (kind = 'function'), 'method_count': count(*) FILTER (kind = 'method'),
 'total_edges': (SELECT count(*) FROM edges), 'cache_hits': 0, 'cache_misses': 0})::VARCHAR FROM nodes""", True)  # fmt: skip
def graph_json(spark, sf_dir):
    return document.graph_json(*_graph(spark, sf_dir))


@query(""", one AS (SELECT * FROM nodes WHERE id = 'R1.N1'), fan AS (SELECT (SELECT count(*) FROM edges WHERE target = 'R1.N1') AS fi, (SELECT count(*) FROM edges WHERE source = 'R1.N1') AS fo)
SELECT 0 AS part, (i - 1)::BIGINT AS seq, ['symbol: ' || name, 'kind: ' || kind, 'docstring: none', 'fan-in: ' || fi, 'fan-out: ' || fo, 'place: ' || module || '.py:' || line || '-' || (line + 4)][i] AS line FROM one, fan, range(1, 7) r(i)
 UNION ALL SELECT 1, edge_seq, coalesce(n.name, source) || ' [' || type || ']' FROM edges LEFT JOIN nodes n ON n.id = source WHERE target = 'R1.N1'
 UNION ALL SELECT 2, edge_seq, coalesce(n.name, target) || ' [' || type || ']' FROM edges LEFT JOIN nodes n ON n.id = target WHERE source = 'R1.N1'
 UNION ALL SELECT 3, 0, count(*) || ' nodes, ' || count(*) FILTER (kind = 'module') || ' module, ' || count(*) FILTER (kind = 'class') || ' class, ' || count(*) FILTER (kind = 'function') || ' function, ' || count(*) FILTER (kind = 'method') || ' method, ' || (SELECT count(*) FROM edges) || ' edges' FROM nodes
 UNION ALL SELECT 3, min(edge_seq) + 1, count(*) || ' ' || type FROM edges GROUP BY type""", True)  # fmt: skip
def chat_context(spark, sf_dir):
    return document.chat_context(*_graph(spark, sf_dir), "R1.N1")


@query(f""", placed AS (SELECT *, (row_number() OVER (PARTITION BY parent_id ORDER BY node_seq) - 1) // {views.PAGE} AS page FROM nodes WHERE parent_id IS NOT NULL),
held AS (SELECT parent_id, page, list({{'node_seq': node_seq, 'id': id, 'name': name, 'kind': kind}} ORDER BY node_seq) AS children FROM placed GROUP BY parent_id, page)
SELECT n.module || '.py' AS file_path, n.id, n.kind, coalesce(page, 0)::BIGINT AS page, coalesce(children, []) AS children FROM nodes n LEFT JOIN held h ON h.parent_id = n.id WHERE kind IN ('module', 'class')""", True)  # fmt: skip
def explorer_tree(spark, sf_dir):
    return views.explorer_tree(star.star_nodes(spark, sf_dir))


# --- extraction and resolution over rendered source --------------------------------------------------------------------------
def _stage_a(spark, sf_dir):
    return cut(star.rendered_stage_a(spark, sf_dir))


_RENDERED = f"""
na AS (SELECT n_nationkey AS n, n_regionkey AS r, 'r' || n_regionkey || '.n' || n_nationkey AS pkg, n_nationkey // 5 AS d, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS base FROM nation),
su AS (SELECT s_suppkey AS s, n, r, pkg, pkg || '.supply_' || (s_suppkey // {star.SUPPLIERS}) AS module FROM supplier JOIN na ON n = s_nationkey),
ok AS (SELECT * FROM su WHERE n <> {star.BROKEN}),
cu AS (SELECT c_custkey AS c, n, r, pkg, pkg || '.buy_' || (c_custkey // {star.CUSTOMERS}) AS module FROM customer JOIN na ON n = c_nationkey),
pr AS (SELECT o_custkey AS c, l_suppkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY l_suppkey) AS k FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)),
three AS (SELECT cu.module AS cmodule, cu.c, ok.module || '.Supplier_' || ok.s AS cls FROM cu JOIN pr ON cu.c = pr.c AND k <= 3 JOIN ok ON ok.s = pr.s),
bases AS (SELECT r, pkg || '.Base_' || r AS id FROM na WHERE base),
extra AS (SELECT pkg, unnest(CASE d WHEN 0 THEN [['Registry', 'class', ''], ['__new__', 'method', 'Registry']] WHEN 1 THEN [['Round', 'class', ''], ['Square', 'class', ''], ['make', 'function', '']]
 WHEN 2 THEN [['Board', 'class', ''], ['tell', 'method', 'Board']] WHEN 3 THEN [['Same', 'class', ''], ['tell', 'method', 'Same'], ['same', 'function', '']] ELSE [] END) AS e FROM na),
nd AS (SELECT pkg AS id, 'n' || n AS name, 'module' AS kind, NULL::VARCHAR AS parent_id FROM na UNION ALL SELECT pkg || '.' || f, f, 'function', pkg FROM na, (VALUES ('helper'), ('lead')) v(f)
 UNION ALL SELECT pkg || '.Base_' || r, 'Base_' || r, 'class', pkg FROM na WHERE base UNION ALL SELECT pkg || '.Base_' || r || '.audit', 'audit', 'method', pkg || '.Base_' || r FROM na WHERE base
 UNION ALL SELECT pkg || CASE WHEN e[3] <> '' THEN '.' || e[3] ELSE '' END || '.' || e[1], e[1], e[2], pkg || CASE WHEN e[3] <> '' THEN '.' || e[3] ELSE '' END FROM extra
 UNION ALL SELECT DISTINCT module, split_part(module, '.', -1), 'module', NULL FROM ok UNION ALL SELECT DISTINCT module, split_part(module, '.', -1), 'module', NULL FROM cu
 UNION ALL SELECT module || '.Supplier_' || s, 'Supplier_' || s, 'class', module FROM ok UNION ALL SELECT module || '.Supplier_' || s || '.' || m, m, 'method', module || '.Supplier_' || s FROM ok, (VALUES ('ship'), ('bill')) v(m)
 UNION ALL SELECT module || '.customer_' || c, 'customer_' || c, 'function', module FROM cu)"""


def rendered(sql: str):
    return f"WITH {_RENDERED}\n{sql}"


@query(rendered("SELECT id, name, kind, parent_id FROM nd"))
def rendered_nodes(spark, sf_dir):
    return extract.nodes(star.rendered_stage_a(spark, sf_dir)).select("id", "name", "kind", "parent_id")


@query(rendered("""SELECT module || '.customer_' || c AS id, (1 + sum(coalesce(lines, 2) + 2) OVER (PARTITION BY module ORDER BY c) - (coalesce(lines, 2) + 2))::INT AS lineno, (sum(coalesce(lines, 2) + 2) OVER (PARTITION BY module ORDER BY c) - 2)::INT AS end_lineno
 FROM (SELECT module, cu.c, 2 + 2 * count(k) AS lines FROM cu LEFT JOIN pr ON cu.c = pr.c AND k <= 3 GROUP BY module, cu.c)"""))  # fmt: skip
def rendered_spans(spark, sf_dir):
    return extract.nodes(star.rendered_stage_a(spark, sf_dir)).where("name LIKE 'customer_%'").select("id", "lineno", "end_lineno")


def _edges(spark, sf_dir, kind):
    return resolve.resolve(_stage_a(spark, sf_dir))[1].where(F.col("type") == kind).select("source", "target")


@query(rendered("SELECT parent_id AS source, id AS target FROM nd WHERE parent_id IS NOT NULL"))
def rendered_defines(spark, sf_dir):
    return _edges(spark, sf_dir, "defines")


@query(rendered("SELECT module || '.Supplier_' || s AS source, id AS target FROM ok JOIN bases USING (r)"))
def rendered_inherits(spark, sf_dir):
    return _edges(spark, sf_dir, "inherits")


@query(rendered("SELECT cmodule || '.customer_' || c AS source, cls AS target FROM three UNION ALL SELECT pkg || '.make', pkg || '.' || x FROM na, (VALUES ('Round'), ('Square')) v(x) WHERE d = 1 UNION ALL SELECT pkg || '.same', pkg || '.Same' FROM na WHERE d = 3"))
def rendered_constructs(spark, sf_dir):
    return _edges(spark, sf_dir, "constructs")


@query(rendered("SELECT cmodule || '.customer_' || c AS source, cls || '.ship' AS target FROM three"))
def rendered_calls_typed(spark, sf_dir):
    return _edges(spark, sf_dir, "calls").where("source LIKE '%.customer_%' AND target LIKE '%.ship'")


@query(rendered("SELECT module || '.Supplier_' || s || '.ship' AS source, module || '.Supplier_' || s || '.bill' AS target FROM ok"))
def rendered_calls_self(spark, sf_dir):
    return _edges(spark, sf_dir, "calls").where("target LIKE '%.bill'")


@query(rendered("SELECT module || '.Supplier_' || s || '.ship' AS source, id || '.audit' AS target FROM ok JOIN bases USING (r)"))
def rendered_calls_inherited(spark, sf_dir):
    return _edges(spark, sf_dir, "calls").where("target LIKE '%.audit'")


@query(rendered("SELECT pkg || '.lead' AS source, pkg || '.helper' AS target FROM na"))
def rendered_calls_function(spark, sf_dir):
    """helper() is in every package: lead() calls that of its own module, and the calls from modules of customers are not resolved."""
    return _edges(spark, sf_dir, "calls").where("target LIKE '%.helper'")


@query(rendered("SELECT pkg || '.lead' AS id, 'Calls its neighbour.' AS docstring FROM na"))
def rendered_docstrings(spark, sf_dir):
    return extract.nodes(star.rendered_stage_a(spark, sf_dir)).where("docstring IS NOT NULL").select("id", "docstring")


@query(rendered("SELECT pkg || CASE d WHEN 0 THEN '.Registry' WHEN 1 THEN '.make' ELSE '.Board' END AS symbol_id, CASE d WHEN 0 THEN 'Singleton' WHEN 1 THEN 'Factory' ELSE 'Observer' END AS pattern FROM na WHERE d <= 2"))
def rendered_patterns(spark, sf_dir):
    a = _stage_a(spark, sf_dir)
    return patterns.detect_patterns(a, extract.nodes(a)).select("symbol_id", "pattern")


@query(rendered(f"SELECT DISTINCT replace(module, '.', '/') || '.py' AS file_path FROM su WHERE n = {star.BROKEN}"))
def rendered_errors(spark, sf_dir):
    return extract.errors(star.rendered_stage_a(spark, sf_dir)).select("file_path")


@query()
def doc_parse_errors(spark, sf_dir):
    """What the parser says of each document, taken as source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py"))
    files = docs.select(F.col("doc_id").alias("file_seq"), path.alias("rel_file_path"), extract.module_path(path, F.lit("docs")).alias("module_path"), F.col("text").alias("content"))
    return extract.errors(extract.stage_a(files))


# --- source slices and text --------------------------------------------------------------------------------------------------
_LINES = r"""WITH s AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS a FROM documents),
l AS (SELECT doc_id, CASE WHEN len(a) > 1 AND a[-1] = '' THEN a[:-2] ELSE a END AS a FROM s)
"""


@query(_LINES + "SELECT doc_id, len(a)::INT AS n_lines, 2 AS start_line, least(4, len(a))::INT AS end_line, len(a) >= 2 AS valid, CASE WHEN len(a) >= 2 THEN a[2:4] ELSE [] END AS lines FROM l")
def source_slice(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fn.line_slice(docs, "text", F.lit(2), F.lit(4)).select("doc_id", "n_lines", "start_line", "end_line", "valid", "lines")


@query(_LINES + "SELECT doc_id, 1 AS start_line, least(8, len(a))::INT AS end_line, a[1:8] AS lines FROM l")
def source_context(spark, sf_dir):
    start, end = fn.context_range(F.lit(3), F.lit(3))
    return fn.line_slice(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", start, end).select("doc_id", "start_line", "end_line", "lines")


@query("SELECT conv_id, turn, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS html FROM conversations")
def html_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", fn.html_escape(F.col("text")).alias("html"))


@query(_LINES + """SELECT doc_id, i::INT AS line_number, '<span id="line-' || i || '">' || replace(replace(replace(replace(replace(a[i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') || '</span>' AS html
 FROM l, range(1, len(a) + 1) r(i)""")  # fmt: skip
def numbered_source(spark, sf_dir):
    return fn.numbered_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text")


_NOTE = r"""WITH s AS (SELECT doc_id, replace(replace(coalesce(text, ''), '"', ''''), '\', '/') AS t FROM documents),
n AS (SELECT doc_id, regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS a FROM s) """


def _notes(spark, sf_dir):
    """A Python file per document: its whole text in a long string over as many lines, code before it, and a comment and code behind it."""
    text = F.translate(F.coalesce("text", F.lit("")), '"\\', "'/")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit('note = """'), text, F.lit('"""  # of '), F.col("doc_id").cast("string"), F.lit("\nif note: kept = 1\n")).alias("text"))


@query(_NOTE + "SELECT doc_id, len(a)::BIGINT + 1 AS n_lines, list_sum(list_transform(a, lambda x: length(x)))::BIGINT + 6 AS string_chars, 5 + length(doc_id::VARCHAR)::BIGINT AS comment_chars, 1::BIGINT AS keywords, 1::BIGINT AS numbers, 3::BIGINT AS names FROM n")
def highlight_notes(spark, sf_dir):
    """What is coloured in a file per document, by kind of token."""
    of = lambda k: F.col("kind") == k
    chars = lambda k: F.coalesce(F.sum(F.when(of(k), F.length("text"))), F.lit(0))
    spans = highlight.token_spans(_notes(spark, sf_dir), "doc_id", "text")
    return spans.groupBy("doc_id").agg(F.max("line_number").cast("long").alias("n_lines"), chars("string").alias("string_chars"), chars("comment").alias("comment_chars"), F.count_if(of("keyword")).alias("keywords"), F.count_if(of("number")).alias("numbers"), F.count_if(of("name")).alias("names"))


_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#039;')"


@query(_NOTE + f"""SELECT doc_id, i::INT AS line_number, '<span id="line-' || i || '">' || CASE WHEN i = len(a) + 1 THEN '<span class="k">if</span> note: kept = <span class="m">1</span>' ELSE
 CASE WHEN i = 1 THEN 'note = ' ELSE '' END || CASE WHEN 1 < i AND i < len(a) AND a[i] = '' THEN '' ELSE '<span class="s">' || CASE WHEN i = 1 THEN '&quot;&quot;&quot;' ELSE '' END || {_ESCAPED.format("a[i]")} ||
 CASE WHEN i = len(a) THEN '&quot;&quot;&quot;' ELSE '' END || '</span>' END || CASE WHEN i = len(a) THEN '  <span class="c"># of ' || doc_id || '</span>' ELSE '' END END || '</span>' AS html FROM n, range(1, len(a) + 2) r(i)""")  # fmt: skip
def highlighted_source(spark, sf_dir):
    """The coloured lines of a file per document."""
    return highlight.coloured_lines(_notes(spark, sf_dir), "doc_id", "text")


@query("SELECT conv_id, turn, url_encode(coalesce(text, '')) AS url FROM conversations")
def url_encoded(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", fn.url_encode(F.coalesce("text", F.lit(""))).alias("url"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def log_tail(spark, sf_dir):
    return fn.tail(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id").select("event_id", "event_type")


@query("""SELECT c_custkey, CASE WHEN len(k) <= 6 THEN '****' WHEN len(k) <= 10 THEN left(k, 2) || '****' || right(k, 2) ELSE left(k, 3) || '****' || right(k, 4) END AS masked,
 replace('key ' || k || ' used', k, '***REDACTED***') AS redacted, sha256(k) AS fingerprint FROM (SELECT c_custkey, right(c_name, (c_custkey % 16 + 1)::INT) AS k FROM customer)""")  # fmt: skip
def mask_redact(spark, sf_dir):
    key = F.right("c_name", (F.col("c_custkey") % 16 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", key.alias("k"))
    return rows.select("c_custkey", fn.mask_key(F.col("k")).alias("masked"), fn.redact(F.concat(F.lit("key "), "k", F.lit(" used")), F.col("k")).alias("redacted"), fn.fingerprint(F.col("k")).alias("fingerprint"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def props_json_extract(spark, sf_dir):
    """The object in replies that wrap it in three ways."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("It is "), "props", F.lit(" as asked.")))
    return events.select("event_id", F.try_variant_get(reconcile.json_object(wrapped), "$.k", "bigint").alias("k"))


# --- clusterings ---------------------------------------------------------------------------------------------------------------
#: Supplier keys of one reply.
REPLY_KEYS = 10_000


def _clusterings(spark, sf_dir):
    """clustering_id, before, reply. A clustering per nation: its suppliers in one component beside an invented symbol, and an empty component without an id.

    A reply holds a block of supplier keys and stays bounded; the nation's suppliers in earlier blocks are counted in before. The last block's reply names what is invented.
    """
    nation, supplier = star.read(spark, sf_dir, "nation", "supplier")
    place = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit(".N"), F.col("n_nationkey").cast("string"))
    held = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    ids = held.groupBy("n_nationkey", F.expr(f"s_suppkey div {REPLY_KEYS}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", F.concat(place, F.lit(".S"), F.col("s_suppkey").cast("string")).alias("id")))).alias("s"))
    # one row per block
    order = Window.partitionBy("n_nationkey").orderBy("block")
    ids = ids.withColumns({"before": F.coalesce(F.sum(F.size("s")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"), "last": F.lead("block").over(order).isNull()})
    quoted = F.array_join(F.transform("s", lambda x: F.concat(F.lit('" '), x["id"], F.lit(' "'))), ", ")
    ghost = F.when(F.col("last"), F.concat(F.lit(', "ghost.'), F.col("n_nationkey").cast("string"), F.lit('"'))).otherwise("")
    spook = F.when(F.col("last"), F.lit('"spook", "R0"')).otherwise("")
    reply = F.concat(F.lit('```json\n{"components": [{"component_id": "c", "name": "suppliers", "member_symbol_ids": ['), quoted, ghost, F.lit('], "role": "r", "rationale": "w"}, {"component_id": " ", "name": "none", "member_symbol_ids": [], "role": "", "rationale": ""}], "unclustered_symbol_ids": ['), spook, F.lit('], "narrative": "n"}\n```'))
    return ids.select(F.col("n_nationkey").alias("clustering_id"), "before", reply.alias("reply"))


@query("SELECT s_nationkey AS clustering_id, 0 AS at, 'c' AS component_id, 'suppliers' AS name, 'r' AS role, 'w' AS rationale, count(*) AS n_members FROM supplier GROUP BY 1 UNION ALL SELECT DISTINCT s_nationkey, 1, 'comp_2', 'none', '', '', 0 FROM supplier")
def cluster_validate(spark, sf_dir):
    return reconcile.components(_clusterings(spark, sf_dir), star.star_nodes(spark, sf_dir))


@query("SELECT s_nationkey AS clustering_id, 0 AS part, 0 AS at, count(*)::INT AS member_at, 'ghost.' || s_nationkey AS symbol_id FROM supplier GROUP BY s_nationkey UNION ALL SELECT DISTINCT s_nationkey, 1, 0, 0, 'spook' FROM supplier")
def cluster_dropped(spark, sf_dir):
    replies = _clusterings(spark, sf_dir).withColumn("clustering_id", F.struct("clustering_id", "before"))
    found = reconcile.dropped(replies, star.star_nodes(spark, sf_dir))
    at = F.col("member_at") + F.when(F.col("part") == 0, F.col("clustering_id.before")).otherwise(0)
    return found.select("clustering_id.clustering_id", "part", "at", at.alias("member_at"), "symbol_id")


@query("SELECT k AS clustering_id, count(*) AS n, min(id) AS first_id FROM (SELECT DISTINCT s_nationkey AS k FROM supplier), nodes WHERE NOT (kind = 'method' AND split_part(id, '.', 3)[1] = 'S' AND split_part(id, '.', 2) = 'N' || k) GROUP BY k", True)
def cluster_unclustered(spark, sf_dir):
    return reconcile.unclustered_counts(_clusterings(spark, sf_dir).select("clustering_id", "reply"), star.star_nodes(spark, sf_dir))


@query("SELECT c_custkey AS clustering_id, CASE c_custkey % 5 WHEN 0 THEN 'no JSON object' WHEN 1 THEN 'no list of components' WHEN 2 THEN 'no narrative' WHEN 3 THEN 'component 0 lacks role, rationale' END AS problem FROM customer WHERE c_custkey % 5 < 4")
def cluster_problems(spark, sf_dir):
    full = '{"components": [], "narrative": "n"}'
    kinds = ["nothing to say", '{"components": 1, "narrative": "n"}', '{"components": []}', '{"components": [{"component_id": "a", "name": "b", "member_symbol_ids": []}], "narrative": "n"}', full]
    reply = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return reconcile.problems(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("clustering_id"), reply.alias("reply")))


# --- survey --------------------------------------------------------------------------------------------------------------------
def _answers(spark, sf_dir):
    """A JSON line per customer; values 1 to 6, so that some do not count; some as texts."""
    item = lambda i: ((F.col("c_custkey") * (i + 3) + F.expr(f"c_custkey div {i + 7}")) % (F.when(F.col("c_custkey") % 4 == 0, 6).otherwise(5)) + 1).cast("string")
    quote = F.when(F.col("c_custkey") % 3 == 0, '"').otherwise("")
    items = F.concat_ws(", ", *[F.concat(F.lit(f'"item{i}": '), quote, item(i), quote) for i in range(1, 11)])
    rubric = F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), item(i + 20)) for i, name in enumerate(survey.RUBRIC)])
    condition = F.when(F.col("c_custkey") % 2 == 0, "baseline").otherwise("advanced")
    line = F.concat(F.lit('{"participantId": "p'), F.col("c_custkey").cast("string"), F.lit('", "condition": "'), condition, F.lit('", "sus": {'), items, F.lit('}, "rubric": {'), rubric, F.lit("}}"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(F.col("c_custkey") % 11 == 0, "no json").otherwise(line).alias("value"))


def _sql_item(i: int) -> str:
    return f"((c_custkey * {i + 3} + c_custkey // {i + 7}) % (CASE WHEN c_custkey % 4 = 0 THEN 6 ELSE 5 END) + 1)"


_SUS = f"""WITH s AS (SELECT 'p' || c_custkey AS participant, CASE WHEN c_custkey % 2 = 0 THEN 'baseline' ELSE 'advanced' END AS condition,
 CASE WHEN greatest({', '.join(_sql_item(i) for i in range(1, 11))}) <= 5 THEN ({' + '.join(f'({_sql_item(i)} - 1)' if i % 2 else f'(5 - {_sql_item(i)})' for i in range(1, 11))}) * 2.5::DOUBLE END AS sus,
 CASE WHEN greatest({', '.join(_sql_item(i) for i in range(20, 23))}) <= 5 THEN ({' + '.join(_sql_item(i) for i in range(20, 23))})::DOUBLE / 3 END AS rubric FROM customer WHERE c_custkey % 11 <> 0),
t AS (SELECT condition, count(*) AS n, avg(sus) AS sus_mean, stddev_pop(sus) AS sus_std, avg(rubric) AS rubric_mean, stddev_pop(rubric) AS rubric_std FROM s WHERE sus IS NOT NULL AND rubric IS NOT NULL GROUP BY condition)
"""


@query("SELECT 'p' || c_custkey AS participant FROM customer WHERE c_custkey % 11 <> 0")
def survey_source(spark, sf_dir):
    """Answers that are written to a folder of text files and read again: lines that are no JSON are left out."""
    folder = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    _answers(spark, sf_dir).write.text(folder)
    return read_answers(spark, folder).select(F.try_variant_get(F.try_parse_json("value"), "$.participantId", "string").alias("participant"))


@query(_SUS + "SELECT participant, condition, sus, rubric FROM s")
def sus_scores(spark, sf_dir):
    return survey.scored(_answers(spark, sf_dir))


@query(_SUS + "SELECT condition, n, round(sus_mean, 6) AS sus_mean, round(sus_std, 6) AS sus_std, round(rubric_mean, 6) AS rubric_mean, round(rubric_std, 6) AS rubric_std FROM t")
def condition_stats(spark, sf_dir):
    stats = survey.condition_stats(survey.scored(_answers(spark, sf_dir)))
    return stats.select("condition", "n", *[F.round(c, 6).alias(c) for c in ("sus_mean", "sus_std", "rubric_mean", "rubric_std")])


@query(_SUS + """SELECT round((a - b) / b * 100, 2) AS sus_pct, round((c - d) / d * 100, 2) AS rubric_pct FROM (SELECT round(max(sus_mean) FILTER (condition = 'advanced'), 2) AS a, round(max(sus_mean) FILTER (condition = 'baseline'), 2) AS b,
 round(max(rubric_mean) FILTER (condition = 'advanced'), 2) AS c, round(max(rubric_mean) FILTER (condition = 'baseline'), 2) AS d FROM t)""")  # fmt: skip
def pct_difference(spark, sf_dir):
    return survey.percent_difference(survey.condition_stats(survey.scored(_answers(spark, sf_dir))))


# --- source trees --------------------------------------------------------------------------------------------------------------
@query("""WITH f AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/' || CASE s_suppkey % 10 WHEN 4 THEN 'p' || s_suppkey || '/__init__' WHEN 5 THEN 'p-' || s_suppkey ELSE 's' || s_suppkey END AS stem, len(s_suppkey::VARCHAR) AS size
 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 NOT IN (1, 2, 3))
SELECT row_number() OVER (ORDER BY string_split(stem || '.py', '/')) - 1 AS file_seq, stem || '.py' AS rel_file_path, replace(regexp_replace(stem, '/__init__$', ''), '/', '.') AS module_path, size::BIGINT AS size FROM f""")  # fmt: skip
def scan_tree(spark, sf_dir):
    """A tree written from the suppliers, listed level by level in tasks, in order of path parts. Its folder is one that driver and executors share as files."""
    shared = shared_folder(spark)
    if "://" in shared and not shared.startswith("file://"):
        raise ValueError("a tree of files needs a shared folder that tasks can open")
    folder = f"{shared.removeprefix('file://')}/tree-{uuid.uuid4().hex}"
    star.write_tree(spark, sf_dir, folder)
    return scan.scan(spark, folder)[0].select("file_seq", "rel_file_path", "module_path", "size")


@query("SELECT 'm' || c_custkey AS id, 'né ' || c_custkey AS docstring FROM customer")
def decoded_docstrings(spark, sf_dir):
    """Files as bytes, of odd keys in Latin-1, which is no UTF-8."""
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit('"""né '), k, F.lit('"""\n'))
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("file_seq"), F.concat(F.lit("m"), k, F.lit(".py")).alias("rel_file_path"), F.concat(F.lit("m"), k).alias("module_path"), F.when(F.col("c_custkey") % 2 == 1, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")).alias("content"))
    return extract.nodes(extract.stage_a(files)).select("id", "docstring")


@query("""SELECT 'm' || c_custkey AS source, 'm' || c_custkey || '.' || t AS target, 'defines' AS type FROM customer, (VALUES ('A'), ('f')) v(t)
 UNION ALL SELECT 'm' || c_custkey || '.A', 'm' || c_custkey || '.A.go', 'defines' FROM customer UNION ALL SELECT 'm' || c_custkey || '.f', 'm' || c_custkey || '.A', 'constructs' FROM customer""")  # fmt: skip
def module_level_calls(spark, sf_dir):
    """A file per customer, all with the same short names: what stands at a module's own level constructs and calls nothing."""
    k = F.col("c_custkey").cast("string")
    code = "class A:\n    def go(self):\n        return 1\n\n\ndef f():\n    return A()\n\n\nx = A()\nx.go()\nf()\n"
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("file_seq"), F.concat(F.lit("m"), k, F.lit(".py")).alias("rel_file_path"), F.concat(F.lit("m"), k).alias("module_path"), F.lit(code).alias("content"))
    return resolve.resolve(cut(extract.stage_a(files)))[1].select("source", "target", "type")


@query(rendered("SELECT id, kind FROM nd"))
def cached_nodes(spark, sf_dir):
    """Parsed files kept in a cache, put there twice, and read back."""
    folder = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    entries = _stage_a(spark, sf_dir).select(F.col("file_seq").cast("double").alias("mtime"), F.lit(1).cast("long").alias("size"), "*")
    cache.save(entries.where("file_seq % 2 = 0"), folder)
    cache.save(entries, folder)
    return extract.nodes(cache.load(spark, folder)).select("id", "kind")


@query(f""", m AS (SELECT n.*, coalesce(i.c, 0)::BIGINT AS fi, coalesce(o.c, 0)::BIGINT AS fo FROM nodes n
 LEFT JOIN (SELECT target, count(*) AS c FROM edges GROUP BY 1) i ON n.id = i.target LEFT JOIN (SELECT source, count(*) AS c FROM edges GROUP BY 1) o ON n.id = o.source)
SELECT 0 AS part, min(node_seq) AS seq, count(*) || ' ' || kind AS line FROM nodes GROUP BY kind
 UNION ALL SELECT 1, node_seq, '- ' || id || ' (' || kind || ') name=' || name || ' module=' || module || ' file=' || module || '.py fan_in=' || fi || ' fan_out=' || fo || ' instability=' || ({_ROUND}) || ' ' FROM m
 UNION ALL SELECT 2, edge_seq, source || ' -> ' || target || ' [' || type || ']' FROM edges UNION ALL SELECT 4, min(edge_seq), type || ': ' || count(*) FROM edges GROUP BY type""", True)  # fmt: skip
def prompt_lines(spark, sf_dir):
    """The lines of a request for a clustering of the whole graph."""
    return reconcile.prompt(*_graph(spark, sf_dir))


# --- incremental analysis and registry -------------------------------------------------------------------------------------------
def _listings(spark, sf_dir):
    """Two listings of a tree: a file per supplier; every seventh is gone, and every fifth is newer, in the second."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    path = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("rel_file_path")
    old = supplier.select(path, F.col("s_suppkey").cast("double").alias("mtime"), F.length("s_name").cast("long").alias("size"))
    new = supplier.where("s_suppkey % 7 <> 0").select(path, (F.col("s_suppkey") + F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0)).cast("double").alias("mtime"), F.length("s_name").cast("long").alias("size"))
    return old, new


@query("SELECT 's' || s_suppkey || '.py' AS rel_file_path, s_suppkey % 5 <> 0 AS hit FROM supplier WHERE s_suppkey % 7 <> 0")
def incremental_hits(spark, sf_dir):
    old, new = _listings(spark, sf_dir)
    hits, misses = cache.split(new, old)
    return hits.select("rel_file_path", F.lit(True).alias("hit")).unionByName(misses.select("rel_file_path", F.lit(False).alias("hit")))


@query("SELECT 's' || s_suppkey || '.py' AS rel_file_path FROM supplier WHERE s_suppkey % 7 = 0")
def incremental_purge(spark, sf_dir):
    old, new = _listings(spark, sf_dir)
    return cache.purged(old, new).select("rel_file_path")


def _models(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("key-"), "n_name"))
    return nation.select(F.col("n_nationkey").cast("long").alias("seq"), F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("cloud").alias("provider"), F.col("n_name").alias("name"), F.lower("n_name").alias("model"), key.alias("key"), (F.col("n_nationkey") % 4 != 0).alias("enabled"), (F.col("n_nationkey") == 5).alias("default_chat"), (F.col("n_nationkey") == 8).alias("default_architecture"))


@query("SELECT 'm' || n_nationkey AS id, n_nationkey % 3 = 0 AS has_key, CASE WHEN n_nationkey % 3 <> 0 THEN '' WHEN len('key-' || n_name) <= 6 THEN '****' WHEN len('key-' || n_name) <= 10 THEN left('key-' || n_name, 2) || '****' || right('key-' || n_name, 2) ELSE left('key-' || n_name, 3) || '****' || right('key-' || n_name, 4) END AS masked_key FROM nation WHERE n_nationkey % 4 <> 0")
def registry_public(spark, sf_dir):
    return registry.public(registry.enabled_only(_models(spark, sf_dir))).select("id", "has_key", "masked_key")


@query("SELECT c_custkey AS request, CASE WHEN c_custkey % 30 < 25 AND (c_custkey % 30) % 4 <> 0 THEN 'm' || (c_custkey % 30) WHEN c_custkey % 2 = 0 THEN 'm5' ELSE 'm1' END AS id FROM customer")
def registry_resolve(spark, sf_dir):
    """The default for architecture is off, so that the first enabled model stands in."""
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("request"), F.concat(F.lit("m"), (F.col("c_custkey") % 30).cast("string")).alias("wanted"), F.when(F.col("c_custkey") % 2 == 0, "chat").otherwise("architecture").alias("feature"))
    return registry.resolve(_models(spark, sf_dir), asked)


@query("SELECT 'm' || n_nationkey AS id, n_nationkey = 6 AS default_chat, n_nationkey = 6 AS default_architecture FROM nation")
def registry_default(spark, sf_dir):
    return registry.set_default(_models(spark, sf_dir), "m6", "both").select("id", "default_chat", "default_architecture")


@query("SELECT 'm' || n_nationkey AS id, n_nationkey = 0 AS default_chat, n_nationkey = 8 AS default_architecture FROM nation WHERE n_nationkey <> 5")
def registry_delete(spark, sf_dir):
    models = _models(spark, sf_dir)
    return registry.delete(models, models.where("seq = 5")).select("id", "default_chat", "default_architecture")


@query("SELECT 'm' || n_nationkey AS id, n_nationkey::BIGINT AS seq, CASE WHEN n_nationkey = 3 THEN 'new' ELSE n_name END AS name, n_nationkey = 3 AS default_chat, CASE WHEN n_nationkey % 3 = 0 THEN 'key-' || n_name END AS key FROM nation UNION ALL SELECT 'm99', 25, 'new', false, NULL")
def registry_upsert(spark, sf_dir):
    new = spark.createDataFrame([(0, "m3", "cloud", "new", "x", "", True, True, False), (0, "m99", "cloud", "new", "x", None, True, False, False)], registry.SCHEMA)
    return registry.upsert(_models(spark, sf_dir), new).select("id", "seq", "name", "default_chat", "key")
