"""Clusterings, registry, survey and text functions."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import reconcile, registry, survey, views

NODES = "node_seq long, id string, name string, kind string, module string, file_path string, lineno int, end_lineno int, parent_id string, docstring string"


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame([(i, s, s, "function", "m", "m.py", 1, 2, None, "d" * 500) for i, s in enumerate("abcd")], NODES), spark.createDataFrame([(0, "a", "b", "calls")], "edge_seq long, source string, target string, type string")


def replies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "clustering_id int, reply string")


GOOD = {"components": [{"component_id": "", "name": "n", "member_symbol_ids": [" a ", "ghost", "b"], "role": "r", "rationale": "x"}], "unclustered_symbol_ids": ["c", "spook"], "narrative": "t"}


def test_clustering(spark, graph):
    nodes, _ = graph
    r = replies(spark, json.dumps(GOOD), "Sure:\n```JSON\n" + json.dumps(GOOD) + "\n```", "It is " + json.dumps(GOOD) + " .")
    assert reconcile.problems(r).isEmpty()
    for i in range(3):
        one = r.where(f"clustering_id = {i}")
        assert [(x.component_id, x.n_members) for x in reconcile.components(one, nodes).collect()] == [("comp_1", 2)]
        assert [x.symbol_id for x in reconcile.dropped(one, nodes).orderBy("part", "at", "member_at").collect()] == ["ghost", "spook"]
        assert sorted(x.symbol_id for x in reconcile.unclustered(one, nodes).collect()) == ["c", "d"]


@pytest.mark.parametrize("reply", ["", "[1]", "{}", '{"components": {}, "narrative": "n"}', '{"components": []}', '{"components": [3], "narrative": "n"}', '{"components": [{"name": "x"}], "narrative": "n"}', '{"components": [{"component_id": "a", "name": "b", "member_symbol_ids": "c", "role": "d", "rationale": "e"}], "narrative": "n"}'])
def test_malformed(spark, reply):
    assert not reconcile.problems(replies(spark, reply)).isEmpty()


def test_cluster_retries_once_and_caches(spark, graph):
    asked, cache = [], reconcile.ClusteringCache()

    def ask(system, prompt):
        asked.append(prompt)
        return "no" if len(asked) == 1 else json.dumps(GOOD)

    assert reconcile.cluster(spark, *graph, ask, cache).count() == 1 and len(asked) == 2 and "rejected" in asked[1]
    reconcile.cluster(spark, *graph, ask, cache)
    assert len(asked) == 2 and len(cache) == 1
    reconcile.cluster(spark, *graph, ask, cache, refresh=True)
    assert len(asked) == 3
    with pytest.raises(reconcile.MalformedClustering):
        reconcile.cluster(spark, *graph, lambda s, p: "no", cache, refresh=True)
    with pytest.raises(RuntimeError):
        reconcile.cluster(spark, *graph, lambda s, p: "[Error] x", cache, refresh=True)


def answer(sus, rubric=(3, 3, 3), condition="baseline"):
    return json.dumps({"participantId": "p", "condition": condition, "sus": {f"item{i}": v for i, v in enumerate(sus, 1) if v != "-"}, "rubric": dict(zip(survey.RUBRIC, rubric))})


def test_sus(spark):
    cases = [([5, 1] * 5, 100.0), ([1, 5] * 5, 0.0), ([3] * 10, 50.0), ([4, 2, 4, 2, 4, 2, 4, 2, 3, 4], 67.5), (["5", 1.9, True, "1", 5, 1, 5, 1, 5, 1], 90.0), (["-"] + [1] * 9, None), ([6] + [1] * 9, None), (["4.7"] + [1] * 9, None), ([None] + [1] * 9, None)]
    rows = spark.createDataFrame([(answer(c),) for c, _ in cases] + [("nonsense",), ("[1]",)], "value string")
    assert [r.sus for r in survey.scored(rows).collect()] == [w for _, w in cases]


def test_stats(spark):
    rows = survey.scored(spark.createDataFrame([(answer([5, 1] * 5),), (answer([3] * 10),), (answer([3] * 10, (1, 2, 9)),), (answer([3] * 10, condition="advanced"),), (answer([3] * 10, condition="other"),)], "value string"))
    stats = survey.condition_stats(rows)
    got = {r.condition: (r.n, r.sus_mean, r.sus_std) for r in stats.collect()}
    assert got == {"baseline": (2, 75.0, 25.0), "advanced": (1, 50.0, 0.0)}
    difference = survey.percent_difference(stats)
    assert difference.first().sus_pct == -33.33 and "75.00" in survey.report(stats, difference)
    assert survey.percent_difference(stats.where("n > 5")).first().sus_pct is None


def test_registry(spark):
    rows = [(0, "a", "p", "A", "m", "k1", True, True, False), (1, "b", "p", "B", "m", None, False, False, True), (2, "c", "p", "C", "m", "k3", True, False, False)]
    models = spark.createDataFrame(rows, registry.SCHEMA)
    asked = spark.createDataFrame([(0, "c", "chat"), (1, "b", "chat"), (2, None, "architecture")], "request int, wanted string, feature string")
    assert {r.request: r.id for r in registry.resolve(models, asked).collect()} == {0: "c", 1: "a", 2: "a"}
    assert {r.id: r.default_chat for r in registry.set_default(models, "c", "both").collect()} == {"a": False, "b": False, "c": True}
    left = {r.id: (r.default_chat, r.default_architecture) for r in registry.delete(models, spark.createDataFrame([("a",)], "id string")).collect()}
    assert left == {"b": (True, True), "c": (False, False)}
    assert "key" not in registry.public(models).columns


def test_text(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc\n",), ("",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(text.lines(F.coalesce("t", F.lit("")))).collect()] == [["a", "b", "c"], [], [], ["x"]]
    rows = text.line_slice(df, "t", F.lit(2), F.lit(9)).collect()
    assert [(r.lines, r.valid) for r in rows] == [(["b", "c"], True), ([], False), ([], False), ([], False)]
    assert spark.range(1).select(text.html_escape(F.lit("<a href='x'>&\"")).alias("h")).first().h == "&lt;a href=&#039;x&#039;&gt;&amp;&quot;"
    keys = spark.createDataFrame([("",), ("abc",), ("12345678",), ("sk-1234567890",)], "k string")
    assert [r[0] for r in keys.select(text.mask_key(F.col("k"))).collect()] == ["", "****", "12****78", "sk-****7890"]


def test_views(spark, graph):
    names = spark.createDataFrame([(0, "b10"), (1, "b9"), (2, "B1"), (3, None), (4, "é2"), (5, "e10")], "node_seq long, name string")
    assert [r.node_seq for r in views.sorted_table(names, "name").collect()] == [3, 2, 1, 0, 4, 5]
    assert [r.node_seq for r in views.sorted_table(names, "name", False).collect()] == [5, 4, 0, 1, 2, 3]
    assert views.table_rows(graph[0]).first().start == "1"
