"""Extraction, resolution, patterns, caches and scans on source files of our own."""

import os
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.operators import extract, patterns, resolve
from codeloom.plans.analyze import analyze, graph_of
from codeloom.sources import cache, scan, settings
from codeloom.streaming import incremental

SHOP = '''"""A shop."""


class Thing:
    def price(self):
        return 1

    def label(self):
        return self.price()


class Book(Thing):
    def price(self):
        return 2


class Pen(Thing):
    """Writes."""


class Cart:
    def add(self, one):
        self.ones.append(one)

    def total(self):
        return self.add(None)


def fill():
    cart = Cart()
    cart.add(Book())
    p: Pen = Pen()
    p.label()
    return cart


def main():
    x = fill()
    if (b := Book()):
        b.price()
    def inner():
        Pen()
'''


def files(spark, **texts):
    rows = [(i, p, c) for i, (p, c) in enumerate(sorted((k.replace("__slash__", "/") + ".py", v) for k, v in texts.items()))]
    df = spark.createDataFrame(rows, "file_seq long, rel_file_path string, content string")
    return df.withColumn("module_path", extract.module_path(F.col("rel_file_path"), F.lit("root")))


def test_shop(spark):
    g = graph_of(extract.stage_a(files(spark, shop=SHOP)))
    nodes = {r.id: r for r in g.nodes.collect()}
    assert sum(r.kind == "class" for r in nodes.values()) == 4 and sum(r.kind == "method" for r in nodes.values()) == 5
    assert nodes["shop.Pen"].docstring == "Writes." and nodes["shop.Pen"].lineno == 17 and nodes["shop"].end_lineno == len(SHOP.splitlines())
    edges = [(r.source, r.target, r.type) for r in g.edges.orderBy("edge_seq").collect()]
    assert len(edges) == len(set(edges))
    assert [e[:2] for e in edges if e[2] == "inherits"] == [("shop.Book", "shop.Thing"), ("shop.Pen", "shop.Thing")]
    assert [e[:2] for e in edges if e[2] == "constructs"] == [("shop.fill", "shop.Cart"), ("shop.fill", "shop.Book"), ("shop.fill", "shop.Pen"), ("shop.main", "shop.Book")]
    assert {e[:2] for e in edges if e[2] == "calls"} == {("shop.Thing.label", "shop.Thing.price"), ("shop.Cart.total", "shop.Cart.add"), ("shop.fill", "shop.Cart.add"), ("shop.fill", "shop.Thing.label"), ("shop.main", "shop.fill"), ("shop.main", "shop.Book.price")}
    assert sum(e[2] == "defines" for e in edges) == len(nodes) - 1


def test_precedence_and_cycles(spark):
    a = extract.stage_a(files(spark, a="class X:\n    def go(self): pass\nclass Loop(Loop):\n    def run(self): self.gone()\n", b="class X:\n    pass\nclass Y(X):\n    pass\nclass Z(a.X):\n    def f(self): self.go()\n", c="class W(X):\n    pass\ndef f():\n    x = Y()\n    x = Z()\n    x.go()\n    X()\n"))
    _, edges = resolve.resolve(a)
    found = {(r.source, r.target) for r in edges.where("type <> 'defines'").collect()}
    # X is ambiguous outside its modules; the last assignment gives a variable its class
    assert found == {("a.Loop", "a.Loop"), ("b.Y", "b.X"), ("b.Z", "a.X"), ("b.Z.f", "a.X.go"), ("c.f", "b.Y"), ("c.f", "b.Z"), ("c.f", "a.X.go")}


def test_errors_keep_others(spark):
    g = graph_of(extract.stage_a(files(spark, bad="def f(:\n", deep="x = " + "(" * 3000 + ")" * 3000, empty="", good="def f(): pass\n")))
    assert {r.file_path for r in g.errors.collect()} == {"bad.py", "deep.py"} and g.errors.where("file_path = 'bad.py'").first().message.startswith("SyntaxError: ")
    assert {(r.id, r.end_lineno) for r in g.nodes.collect()} == {("empty", 1), ("good", 1), ("good.f", 1)}


CASES = {
    "Singleton": ["class A:\n    one = None\n    def __new__(cls):\n        if A.one == None:\n            A.one = super().__new__(cls)\n        return A.one\n"],
    "Factory": ["class P: pass\nclass Q: pass\ndef f(k):\n    if k:\n        return m.P()\n    else:\n        for _ in k:\n            return Q()\n"],
    "Observer": ["class A:\n    def f(self):\n        for i, o in self.all:\n            o.tell()\n"],
    None: ["class A:\n    def f(self, xs):\n        for x in xs:\n            x.tell()\n", "class P: pass\ndef f(k):\n    if k:\n        return P()\n    else:\n        return P()\n", "class P: pass\nclass Q: pass\ndef f(k):\n    if k:\n        return P()\n    return Q()\n", "class A:\n    def __new__(cls):\n        if cls.one is None:\n            cls.two = 1\n        return cls.one\n"],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in CASES.items() for t in ts])
def test_patterns(spark, kind, text):
    a = extract.stage_a(files(spark, m=text))
    assert [r.pattern for r in patterns.detect_patterns(a, extract.nodes(a)).collect()] == ([kind] if kind else [])


def test_paths(spark):
    df = spark.createDataFrame([("a/b.py",), ("a/__init__.py",), ("__init__.py",), ("a.b/c.py",)], "p string")
    assert [r[0] for r in df.select(extract.module_path(F.col("p"), F.lit("root"))).collect()] == ["a.b", "a", "root", "a.b.c"]


def test_incremental(spark, tmp_path):
    root, store = tmp_path / "p", str(tmp_path / "cache")
    (root / "pkg" / ".hidden").mkdir(parents=True)
    (root / "build").mkdir()
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "_s.py").write_text("class Service:\n    def connect(self): pass\n")
    (root / "c.py").write_bytes("class Client:\n    def go(self):\n        x = Service()\n        x.connect()  # \xe9\n".encode("latin-1"))
    (root / "build" / "x.py").write_text("def no(): pass\n")
    want = {("c.Client.go", "pkg._s.Service", "constructs"), ("c.Client.go", "pkg._s.Service.connect", "calls")}
    cross = lambda g: {(r.source, r.target, r.type) for r in g.edges.where("type <> 'defines'").collect()}
    g, hits, misses = analyze(spark, str(root), store)
    assert (hits, misses) == (0, 3) and cross(g) == want
    assert analyze(spark, str(root), store)[1:] == (3, 0) and analyze(spark, str(root), store, refresh=True)[1:] == (0, 3)
    (root / "c.py").write_text((root / "c.py").read_text("latin-1") + "\n\n")
    os.utime(root / "c.py", (1, 1))
    g, hits, misses = analyze(spark, str(root), store)
    assert (hits, misses) == (2, 1) and cross(g) == want
    full = analyze(spark, str(root))[0]
    assert sorted(map(tuple, g.edges.drop("edge_seq").collect())) == sorted(map(tuple, full.edges.drop("edge_seq").collect()))
    (root / "pkg" / "_s.py").unlink()
    g, hits, misses = analyze(spark, str(root), store)
    assert (hits, misses) == (2, 0) and not cross(g) and cache.load(spark, store).count() == 2


def test_roots(spark, tmp_path):
    with pytest.raises(ValueError):
        scan.resolve_path("  ")
    with pytest.raises(FileNotFoundError):
        scan.resolve_path(str(tmp_path / "none"))
    (tmp_path / "a.txt").write_text("")
    with pytest.raises(ValueError):
        scan.resolve_path(str(tmp_path / "a.txt"))
    (tmp_path / "one.py").write_text("def f(): pass\n")
    assert {r.id for r in analyze(spark, str(tmp_path / "one.py"))[0].nodes.collect()} == {"one", "one.f"}
    (tmp_path / "empty").mkdir()
    g = analyze(spark, str(tmp_path / "empty"))[0]
    assert g.nodes.isEmpty() and "No .py files" in g.errors.first().message


def test_settings(tmp_path):
    path = str(tmp_path / "c.json")
    assert settings.load(path) == settings.DEFAULTS
    settings.save(path, {"ai_enabled": True})
    assert settings.load(path)["ai_enabled"] is True
    (tmp_path / "c.json").write_text("[1")
    assert settings.load(path) == settings.DEFAULTS


def test_cache_survives_unreadable_files_and_keeps_two_manifests(spark, tmp_path):
    source, store = tmp_path / "src", tmp_path / "cache"
    source.mkdir()
    (source / "a.py").write_text("class A:\n    def f(self):\n        return 1\n")
    (source / "b.py").write_text("from a import A\nclass B(A):\n    pass\n")
    first = analyze(spark, str(source), cache_folder=str(store))
    assert first[1:] == (0, 2)
    (store / "data-unfinished").mkdir()
    (store / "draft-unfinished").write_text("{")
    assert analyze(spark, str(source), cache_folder=str(store))[1:] == (2, 0)
    for part in store.glob("data-*/bucket=*/part-*.parquet"):
        part.write_bytes(b"no Parquet")
    again = analyze(spark, str(source), cache_folder=str(store))
    assert again[1:] == (0, 2)
    ids = lambda g: sorted(r.id for r in g[0].nodes.select("id").collect())
    assert ids(first) == ids(again)
    assert len(list(store.glob("manifest-*"))) == 2 and not (store / "data-unfinished").exists() and not (store / "draft-unfinished").exists()
    assert analyze(spark, str(source), cache_folder=str(store))[1:] == (2, 0)


def test_stream_keeps_the_cache_up_to_date(spark, tmp_path):
    feed, store, marks = str(tmp_path / "feed"), str(tmp_path / "cache"), str(tmp_path / "marks")
    schema = "file_seq long, rel_file_path string, module_path string, mtime double, size long, content binary"
    rows = [(0, "a.py", "p.a", 1.0, 20, b"def f():\n    pass\n"), (0, "a.py", "p.a", 2.0, 20, b"def g():\n    pass\n"), (1, "b.py", "p.b", 1.0, 20, b"def h():\n    pass\n")]
    for batch in (rows, [(1, "b.py", "p.b", 3.0, 22, b"def hh():\n    pass\n")], []):
        if batch:
            spark.createDataFrame(batch, schema).write.mode("append").parquet(feed)
        incremental.follow(spark.readStream.schema(schema).parquet(feed), store, marks).awaitTermination()
        kept = cache.load(spark, store)
        names = sorted(r.id for r in extract.nodes(kept).where("kind = 'function'").collect())
        assert names == (["p.a.g", "p.b.h"] if len(batch) == 3 else ["p.a.g", "p.b.hh"]) and kept.count() == 2


class Held:
    """A table of one batch that is mapped here, not in a worker."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run(iter([self.batch]))

    def mapInPandas(self, run, _):
        return run(iter([self.batch.to_pandas()]))


def test_a_batch_of_files_is_parsed_by_portions(spark):
    code = "".join(f"def f{k}():\n    v = A{k}()\n    v.go()\n    g()\n\n\n" for k in range(100))
    files = [(i, f"m{i}.py", f"m{i}", None if i % 50 == 0 else code) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files)], ["file_seq", "rel_file_path", "module_path", "content"])
    tracemalloc.start()
    try:
        got = [(n, len(x)) for part in extract.stage_a(Held(batch)) for n, x in zip(part["file_seq"].to_pylist() if isinstance(part, pa.RecordBatch) else part["file_seq"], part["nodes"])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == [(i, 1 if i % 50 == 0 else 101) for i in range(300)]
    assert peak < 24 << 20, peak
    assert list(extract.portions([5, None, 1 << 20, 1 << 17, 1 << 17, 1])) == [(0, 2), (2, 1), (3, 2), (5, 1)] and list(extract.portions([])) == []
