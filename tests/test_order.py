"""Numbers that follow an order, and what rests on them: the explorer's pages, complements and lists of files."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codeloom.functions.order import numbered, ordinals
from codeloom.operators import graph, reconcile, views
from codeloom.sources import scan

NODES = "node_seq long, id string, name string, kind string, module string, file_path string, lineno int, end_lineno int, parent_id string, docstring string"


def test_numbered_and_ordinals(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", (i * 37) % 500) for i in range(500)] + [(None, 1), (None, 0)]
    table = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = {(r.g, r.v): r.n for r in numbered(table, [F.col("g"), F.col("v")], "n").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert got == {r: n for n, r in enumerate(order)}
    for r in ordinals(table, "g", [F.col("v").desc()], "n").collect():
        assert r.n == sum(g == r.g and v > r.v for g, v in rows)
    assert numbered(table.limit(0), [F.col("v")], "n").count() == 0


def test_pages_of_the_explorer(spark):
    """A class with many methods has pages, none of which is larger than a page; together they are the class."""
    rows = [(0, "m", "m", "module", "m", "m.py", 1, 9, None, None), (1, "m.C", "C", "class", "m", "m.py", 1, 9, "m", None), (2, "m.E", "E", "class", "m", "m.py", 1, 9, "m", None)]
    rows += [(10 + i, f"m.C.f{i}", f"f{i}", "method", "m", "m.py", 1, 9, "m.C", None) for i in range(95)]
    pages = views.explorer_tree(spark.createDataFrame(rows, NODES).repartition(3), 10).collect()
    assert max(len(r.children) for r in pages) == 10 and all(r.file_path == "m.py" for r in pages)
    assert [c.id for r in sorted((r for r in pages if r.id == "m.C"), key=lambda r: r.page) for c in r.children] == [f"m.C.f{i}" for i in range(95)]
    assert [(r.page, [c.id for c in r.children]) for r in pages if r.id == "m"] == [(0, ["m.C", "m.E"])] and [(r.page, r.children) for r in pages if r.id == "m.E"] == [(0, [])]


@pytest.mark.parametrize("stretch", [3, 10_000])
def test_unclustered(spark, stretch, monkeypatch):
    monkeypatch.setattr(reconcile, "_STRETCH", stretch)
    ids = [f"s{i:03}" for i in range(40)]
    nodes = spark.createDataFrame([(i, s, s, "function", "m", "m.py", 1, 2, None, None) for i, s in enumerate([*ids, ids[4]])], NODES)
    members = {0: [], 1: ids, 2: ids[1:], 3: ids[:-1], 4: ids[::2], 5: ["gone", ids[0], ids[0], ids[1], ids[7]], 6: ids[10:20]}
    reply = lambda m: json.dumps({"components": [{"component_id": "a", "name": "n", "member_symbol_ids": m, "role": "r", "rationale": "x"}], "narrative": "t"})
    rows = spark.createDataFrame([*((k, reply(m)) for k, m in members.items()), (7, "no reply")], "clustering_id int, reply string")
    want = {k: [s for s in ids if s not in members.get(k, [])] for k in range(8)}
    got = reconcile.unclustered(rows, nodes).collect()
    assert sorted(map(tuple, got)) == sorted((k, s) for k, m in want.items() for s in m)
    counts = {r.clustering_id: (r.n, r.first_id) for r in reconcile.unclustered_counts(rows, nodes).collect()}
    assert counts == {k: (len(m), min(m, default=None)) for k, m in want.items()}


def test_listing(spark, tmp_path):
    """Files in order of path parts, as a walk of the driver finds them, and no folder listed on the driver."""
    names = ["a/b.py", "a-b.py", "a.py", "_x.py", "a/__init__.py", "a/c/d/e/f.py", "a/build/no.py", "venv/no.py", ".h/no.py", "a/.h.py", "a/t.txt", "é/日.py", "Z.py", "a/c/dist/x.py", "a/c/distx/x.py", "b.py/in.py"]
    for n in names:
        p = tmp_path / "root" / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("#" * len(n))
    os.symlink(tmp_path / "root", tmp_path / "root" / "a" / "loop")
    (tmp_path / "root" / "empty").mkdir()
    found, problems = scan.scan(spark, str(tmp_path / "root"))
    want = sorted((n for n in names if not any(scan.skipped(x) for x in n.split("/")) and n.endswith(".py")), key=lambda n: n.split("/"))
    rows = found.orderBy("file_seq").collect()
    assert not problems and [r.rel_file_path for r in rows] == want and [r.file_seq for r in rows] == list(range(len(want)))
    assert all(r.size == len(r.rel_file_path) and r.mtime == Path(r.path).stat().st_mtime for r in rows)
    assert [r.rel_file_path for r in scan.scan(spark, str(tmp_path / "root" / "a" / "b.py"))[0].collect()] == ["b.py"]
    hidden = tmp_path / ".up" / "root"
    hidden.mkdir(parents=True)
    (hidden / "a.py").write_text("")
    assert scan.scan(spark, str(hidden))[0].count() == 1 and scan.scan(spark, str(hidden), absolute_rule=True)[0].count() == 0
    assert "does not exist" in scan.scan(spark, str(tmp_path / "none"))[1][0][1] and "No .py files" in scan.scan(spark, str(tmp_path / "root" / "empty"))[1][0][1]


def test_the_driver_lists_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("")
    for name in ("scandir", "walk", "listdir"):
        monkeypatch.setattr(os, name, lambda *a, **k: pytest.fail("listed on the driver"))
    assert scan.scan(spark, str(tmp_path))[0].count() == 1


def test_lookup_of_many_texts(spark):
    """As a search of all nodes for each text."""
    ids = ["a", "b.a", "ba", "x.y.ba", "É", "z.É", "a.", "long" * 20, "", "c"]
    rows = [(i * 7 % 11, s, n) for i, (s, n) in enumerate(zip(ids, ["n", "a", None, "ba", "é", "q", "", "a", "w", "x.y.ba"]))]
    asked = ["a", "ba", ".a", "y.ba", "É", "é", "", "zz", "long", "ong" + "long" * 19, "x.y.ba", "ax.y.ba", None, "a", "."]
    nodes = spark.createDataFrame(rows, "node_seq long, id string, name string")
    got = {r.query: r.id for r in graph.view_lookup_all(nodes, spark.createDataFrame([(q,) for q in asked], "query string")).collect()}
    order = sorted(rows)
    assert got == {q: f for q in asked if q is not None and (f := next((i for _, i, n in order if i == q or n == q or i.endswith(q)), None)) is not None}
