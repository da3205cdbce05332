"""Metrics, lookups and impact on a small graph of our own."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions.text import two_decimals
from codeloom.model import EDGES, NODES
from codeloom.operators import graph


@pytest.fixture(scope="module")
def zoo(spark):
    nodes = [(0, "z", "z", "module", None), (1, "z.Base", "Base", "class", "z"), (2, "z.Owl", "Owl", "class", "z"), (3, "z.Ape", "Ape", "class", "z"), (4, "z.build", "build", "function", "z"), (5, "z.main", "main", "function", "z"), (6, "z.Owl.fly", "fly", "method", "z.Owl")]
    edges = [(0, "z", "z.Base", "defines"), (1, "z", "z.Owl", "defines"), (2, "z", "z.Ape", "defines"), (3, "z", "z.build", "defines"), (4, "z", "z.main", "defines"), (5, "z.Owl", "z.Owl.fly", "defines"), (6, "z.Owl", "z.Base", "inherits"), (7, "z.Ape", "z.Base", "inherits"), (8, "z.build", "z.Owl", "constructs"), (9, "z.build", "z.Ape", "constructs"), (10, "z.main", "z.build", "calls"), (11, "z.main", "z.main", "calls"), (12, "z.main", "lost", "calls")]
    return spark.createDataFrame(nodes, "node_seq long, id string, name string, kind string, parent_id string").withColumns({"module": F.lit("z"), "file_path": F.lit("z.py")}), spark.createDataFrame(edges, "edge_seq long, source string, target string, type string")


def test_fan_metrics(zoo):
    got = {r.id: (r.fan_in, r.fan_out, r.instability) for r in graph.fan_metrics(*zoo).collect()}
    assert got["z"] == (0, 5, 1.0) and got["z.Base"] == (3, 0, 0.0) and got["z.main"] == (2, 3, 0.6) and "lost" not in got and len(got) == 7
    assert sum(v[1] for v in got.values()) == 13


def test_impact(zoo, spark):
    nodes, edges = zoo
    starts = spark.createDataFrame([("z.Base",), ("z.main",), ("none",)], "start_id string")
    rows = graph.impact(nodes, edges, starts).orderBy("start_id", "depth", "path").collect()
    assert [(r.id, r.depth, r.via_edge_type) for r in rows if r.start_id == "z.Base"] == [("z.Owl", 1, "inherits"), ("z.Ape", 1, "inherits"), ("z.build", 2, "constructs"), ("z.main", 3, "calls")]
    assert not [r for r in rows if r.start_id != "z.Base"]
    assert graph.impact(nodes, edges, starts, max_depth=0).isEmpty()


def test_impact_breadth_first_order(spark):
    """The edge that is found first is that of a queue, on random graphs."""
    rng = random.Random(4)
    for _ in range(3):
        ids = [f"n{i}" for i in range(14)]
        edges = [(i, rng.choice(ids), rng.choice(ids), rng.choice(["calls", "constructs", "inherits", "defines"])) for i in range(40)]
        want, queue, seen = [], [("n0", 0)], {"n0"}
        while queue:
            here, depth = queue.pop(0)
            for _, s, t, kind in edges if depth < 5 else []:
                if t == here and kind != "defines" and s not in seen:
                    seen.add(s)
                    want.append((s, depth + 1, kind))
                    queue.append((s, depth + 1))
        nodes = spark.createDataFrame([(i, n, n, "function") for i, n in enumerate(ids)], "node_seq long, id string, name string, kind string")
        found = graph.impact(nodes, spark.createDataFrame(edges, "edge_seq long, source string, target string, type string"), spark.createDataFrame([("n0",)], "start_id string"))
        assert [(r.id, r.depth, r.via_edge_type) for r in found.orderBy("depth", "path").collect()] == want


def test_lookup(zoo):
    nodes, edges = zoo
    assert graph.lookup(nodes, "z.Owl").first().id == "z.Owl" and graph.lookup(nodes, "Owl.fly").first().id == "z.Owl.fly" and graph.lookup(nodes, "x").first() is None
    assert graph.symbol_detail(nodes, edges, "Base").first().fan_in == 3
    near = graph.neighbours(nodes, edges).where("id = 'z.main'").orderBy("direction", "edge_seq").collect()
    assert [(r.direction, r.neighbour_id, r.neighbour_name) for r in near] == [("incoming", "z", "z"), ("incoming", "z.main", "main"), ("outgoing", "z.build", "build"), ("outgoing", "z.main", "main"), ("outgoing", "lost", "lost")]


def test_rounding_is_pythons(spark):
    pairs = [(a, b) for b in range(0, 420, 7) for a in range(b + 1)]
    rows = spark.createDataFrame(pairs, "a long, b long").withColumn("r", two_decimals(F.col("a"), F.col("b"))).collect()
    assert all(r.r == (round(r.a / r.b, 2) if r.b else 0.0) for r in rows)


def test_fingerprint_ignores_order(zoo):
    nodes, edges = zoo
    one = graph.fingerprint(nodes, edges).first()
    assert one == graph.fingerprint(nodes.orderBy(F.desc("id")), edges.repartition(3)).first() != graph.fingerprint(nodes, edges.where("edge_seq > 0")).first()


def test_dedupe_keeps_first(spark):
    edges = spark.createDataFrame([(3, "a", "b", "calls"), (1, "a", "b", "calls"), (2, "a", "b", "defines"), (4, "", "b", "calls")], "edge_seq long, source string, target string, type string")
    assert sorted(map(tuple, graph.dedupe_edges(edges).collect())) == [(1, "a", "b", "calls"), (2, "a", "b", "defines")]


def test_sums_of_what_differs_give_the_fingerprint(spark):
    nodes = spark.createDataFrame([(i, f"m{i % 3}.s{i}", f"s{i}", "class", f"m{i % 3}", f"m{i % 3}.py", 1, 2, None, None) for i in (*range(30), 4)], NODES)
    edges = spark.createDataFrame([(i, f"m{i % 3}.s{i % 30}", f"m{i * 7 % 3}.s{i * 7 % 30}", ("calls", "inherits")[i % 2]) for i in range(60)] + [(60, "none", "m0.s0", "calls")], EDGES)
    found = spark.createDataFrame([("Observer", "m1.s1", "loops"), ("Observer", "m1.s1", "loops"), ("Factory", "gone", "tells")], "pattern string, symbol_id string, evidence string")
    moved = lambda rows: rows.withColumn("file_path", F.when(F.col("id") == "m1.s4", "other.py").otherwise(F.col("file_path")))
    of = lambda sums: graph.digests_fingerprint(sums).first()[0]
    digests, totals = graph.file_digests(nodes, edges, found), graph.digest_totals
    one = nodes.where("id = 'm1.s4'")
    changed = [(edges.where("type <> 'inherits'"), nodes, found, totals(edges=edges.where("type = 'inherits'")), None), (edges, moved(nodes), found, totals(one), totals(moved(one))), (edges, nodes, found.limit(0), totals(patterns=found), None)]
    seen = {of(digests), graph.fingerprint(nodes, edges, found).first()[0]}
    assert len(seen) == 1
    for e, n, p, gone, new in changed:
        got = of(graph.replaced(digests, gone, new))
        assert got == of(graph.file_digests(n, e, p)) == graph.fingerprint(n, e, p).first()[0]
        seen.add(got)
    assert len(seen) == 4


def test_a_fingerprint_of_the_whole_graph_joins_nothing(spark):
    nodes, edges = spark.createDataFrame([], NODES), spark.createDataFrame([(1, "a", "b", "calls")], EDGES)
    assert "Join" not in graph.fingerprint(nodes, edges)._jdf.queryExecution().optimizedPlan().toString()


def test_sums_of_digests_are_those_of_python(spark):
    ends = [(f"a{i}\"é", f"b{i}\\", "calls") for i in range(50)] * 2
    digests = [hashlib.sha256(json.dumps({"source": s, "target": t, "type": k}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for s, t, k in ends]
    got = graph.digest_totals(edges=spark.createDataFrame([(0, *x) for x in ends], EDGES))
    assert got.first()[:] == ("edge", 100, *(sum(int(d[12 * i : 12 * i + 12], 16) for d in digests) for i in range(5)))
    assert [got.schema[f"s{i}"].dataType.simpleString() for i in range(5)] == ["decimal(38,0)"] * 5
