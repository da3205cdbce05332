"""The graph as a document, chat context, registry files, requests in parts, and text functions."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import document, graph, reconcile, resolve, views
from codeloom.sources import settings
from codeloom.sources.survey import read_answers

NODES = "node_seq long, id string, name string, kind string, module string, file_path string, lineno int, end_lineno int, parent_id string, docstring string"
EDGES = "edge_seq long, source string, target string, type string"


def small(spark):
    rows = [(0, "m", "m", "module", "m", "m.py", 1, 9, None, None), (1, "m.A", "A", "class", "m", "m.py", 2, 5, "m", 'says "hi"'), (2, "m.A.f", "f", "method", "m", "m.py", 3, 4, "m.A", None), (3, "m.g", "g", "function", "m", "m.py", 7, 8, "m", None)]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(0, "m", "m.A", "defines"), (1, "m.g", "m.A", "constructs"), (2, "m.A", "gone", "calls")], EDGES)


def test_graph_is_one_document(spark, tmp_path):
    nodes, edges = small(spark)
    errors = spark.createDataFrame([("b.py", "bad")], "file_path string, message string")
    document.json_lines(document.graph_json(nodes, edges, errors)).write.text(f"file://{tmp_path}/graph")
    said = json.loads("".join(p.read_text() for p in sorted((tmp_path / "graph").glob("part-*"))))
    assert [n["id"] for n in said["nodes"]] == ["m", "m.A", "m.A.f", "m.g"] and said["nodes"][1]["docstring"] == 'says "hi"' and said["nodes"][0]["parent_id"] is None
    assert [e["type"] for e in said["edges"]] == ["defines", "constructs", "calls"] and said["errors"] == [{"file_path": "b.py", "message": "bad"}] and said["patterns"] == [] and said["summary"][0]["total_edges"] == 3
    empty = json.loads("".join(r.value for r in document.json_lines(document.graph_json(nodes.limit(0), edges.limit(0))).collect()))
    assert empty["nodes"] == [] and empty["summary"][0]["total_nodes"] == 0


def test_chat_context(spark):
    nodes, edges = small(spark)
    files = spark.createDataFrame([("m.py", "\n".join(f"line {i}" for i in range(1, 10))), ("n.py", "x")], "rel_file_path string, content string")
    said = {}
    for r in document.chat_context(nodes, edges, "A", files).orderBy("part", "seq").collect():
        said.setdefault(r.part, []).append(r.line)
    assert said[0] == ["symbol: A", "kind: class", 'docstring: says "hi"', "fan-in: 2", "fan-out: 1", "place: m.py:2-5"]
    assert said[1] == ["m [defines]", "g [constructs]"] and said[2] == ["gone [calls]"] and said[4] == ["line 2", "line 3", "line 4", "line 5"]
    assert said[3][0] == "4 nodes, 1 module, 1 class, 1 function, 1 method, 3 edges" and sorted(said[3][1:]) == ["1 calls", "1 constructs", "1 defines"]
    assert {r.part for r in document.chat_context(nodes, edges, "nothing", files).collect()} == {3}


def test_explorer_tree(spark):
    rows = {r.id: [c.id for c in r.children] for r in views.explorer_tree(small(spark)[0]).collect()}
    assert rows == {"m": ["m.A", "m.g"], "m.A": ["m.A.f"]}


def test_registry_file(tmp_path):
    path, own = f"{tmp_path}/models.json", f"{tmp_path}/config.json"
    settings.save(own, {"ollama_model": "tiny"})
    first = settings.load_registry(path, own)
    assert [(r["model_name"], r["is_default_chat"]) for r in first] == [("tiny", True)]
    assert json.loads((tmp_path / "models.json").read_text()) == {"version": 1, "models": first}
    settings.save_registry(path, [*first, {**first[0], "id": "b"}])
    assert [r["id"] for r in settings.load_registry(path, own)] == ["ollama-default", "b"]
    settings.save_registry(path, [])
    assert len(settings.load_registry(path, own)) == 1
    (tmp_path / "models.json").write_text("{")
    assert len(settings.load_registry(path, own)) == 1 and (tmp_path / "models.json").read_text() == "{"
    assert "ollama_models_dir" in settings.load(f"{tmp_path}/none.json")


def test_request_in_parts(spark):
    nodes, edges = small(spark)
    reply = {"components": [{"component_id": "a", "name": "n", "member_symbol_ids": ["m.A"], "role": "r", "rationale": "x"}], "narrative": "t"}
    asked = []
    rows = reconcile.cluster(spark, nodes, edges, lambda s, p: asked.append(p) or json.dumps(reply), reconcile.ClusteringCache(), most_lines=4).collect()
    lines = "\n".join(asked).split("\n")
    assert len(asked) > 2 and all(p.count("\n") < 4 for p in asked) and sum(x.startswith("- m") for x in lines) == 4 and "m.g -> m.A [constructs]" in lines
    one = json.loads(rows[0].reply)
    assert len(one["components"]) == len(asked) and one["narrative"].count("t") == len(asked)


def test_deep_inheritance(spark):
    """A chain of bases of any length is walked to its end."""
    chain = spark.createDataFrame([(f"c{i}", 0, i, f"c{i + 1}") for i in range(80)], "class_id string, file_seq long, at int, base_id string")
    found = resolve.ancestors(chain, spark.createDataFrame([("c0",)], "class_id string"))
    assert found.count() == 81


def test_fingerprint_order(spark):
    nodes, edges = small(spark)
    assert graph.fingerprint(nodes, edges).first() == graph.fingerprint(nodes.orderBy(F.desc("id")), edges.repartition(3)).first() != graph.fingerprint(nodes, edges.limit(2)).first()


def test_text_functions(spark):
    rows = spark.createDataFrame([("a 1&é~*+",), ("x" + "1" * 25 + "0",), ("x" + "1" * 25 + "2",), ("X7",), ("x007",), ("",)], "t string")
    assert rows.select(text.url_encode(F.col("t"))).first()[0] == "a%201%26%C3%A9~%2A%2B"
    ranks = [r[0] for r in rows.select(F.monotonically_increasing_id().alias("i"), F.dense_rank().over(Window.orderBy(text.natural_key(F.col("t")))).alias("r")).orderBy("i").select("r").collect()]
    assert ranks[3] == ranks[4] < ranks[1] < ranks[2] and ranks[5] == 1
    names = spark.createDataFrame([("Šárka 10",), ("sarka 9",), ("ŒUVRE",), ("oeuvre",), ("ωμέγα",), ("Ωμεγα",), ("ωμεγβ",), (None,)], "t string").withColumn("r", F.dense_rank().over(Window.orderBy(text.natural_key(F.col("t")))))
    assert {r.t: r.r for r in names.collect()} == {None: 1, "ŒUVRE": 2, "oeuvre": 2, "sarka 9": 3, "Šárka 10": 4, "ωμέγα": 5, "Ωμεγα": 5, "ωμεγβ": 6}
    lines = text.numbered_lines(spark.createDataFrame([(1, "a<b\n\nc\n"), (2, None)], "k int, t string"), "t").collect()
    assert [(r.k, r.line_number, r.html) for r in lines if r.k == 1] == [(1, 1, '<span id="line-1">a&lt;b</span>'), (1, 2, '<span id="line-2"></span>'), (1, 3, '<span id="line-3">c</span>')]
    assert [r.i for r in text.tail(spark.range(500).withColumnRenamed("id", "i"), "i").collect()] == list(range(499, 399, -1))


def test_answers(spark, tmp_path):
    (tmp_path / "a.JSON").write_text('{"x": 1}\nno\n')
    (tmp_path / "b.csv").write_text('{"x": 2}\n')
    assert [r.value for r in read_answers(spark, f"file://{tmp_path}").collect()] == ['{"x": 1}'] and read_answers(spark, f"file://{tmp_path}/none").isEmpty()
