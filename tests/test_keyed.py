"""Keyed tables in buckets, the stream and the replies that rest on them."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from codeloom.operators import extract, graph, reconcile
from codeloom.sources import cache, settings
from codeloom.sources.keyed import KeyedTable
from codeloom.streaming import incremental

FEED = "file_seq long, rel_file_path string, module_path string, mtime double, size long, content binary"


def put(spark, table, pairs, gone=(), **how):
    rows = spark.createDataFrame(pairs, table.schema) if pairs else None
    return table.update(rows, spark.createDataFrame([(k,) for k in gone], "k string") if gone else None, **how)


def test_updates_rewrite_their_own_buckets(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k string, v int", "k", buckets=8)
    assert table.load().count() == 0 and table.update() == [] and put(spark, table, [], ["none"]) != []
    put(spark, table, [(f"k{i}", i) for i in range(100)])
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("data-*/bucket=*/*.parquet"))
    before = {p for p in (tmp_path / "t").glob("data-*/bucket=*/*.parquet")}
    for number in range(3):
        touched = put(spark, table, [("k7", 1000 + number), ("new", number)], ["k9"])
        new = {p for p in (tmp_path / "t").glob("data-*/bucket=*/*.parquet")} - before
        before |= new
        assert len(touched) <= 3 and {int(p.parent.name.split("=")[1]) for p in new} <= set(touched)
        assert sum(p.stat().st_size for p in new) < size * 5 / 8
        assert {r.k: r.v for r in table.load().collect()} == {f"k{i}": i for i in range(100) if i != 9} | {"k7": 1000 + number, "new": number}
    assert len(list((tmp_path / "t").glob("manifest-*"))) == 2
    # the number of buckets is the table's own
    assert put(spark, KeyedTable(spark, f"{tmp_path}/t", "k string, v int", "k", buckets=3), [], [f"k{i}" for i in range(100)] + ["new"]) == list(range(8))
    assert table.load().count() == 0
    table.clear()
    assert not (tmp_path / "t").exists()


def test_a_reader_keeps_the_table_that_it_began_with(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k string, v int", "k", buckets=2)
    put(spark, table, [("a", 1), ("b", 1)])
    held = table.load()
    put(spark, table, [("a", 2)])
    assert sorted(r.v for r in held.collect()) == [1, 1] and sorted(r.v for r in table.load().collect()) == [1, 2]


def test_an_update_that_fails_leaves_the_table(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k string, v int", "k", buckets=2)
    put(spark, table, [(f"k{i}", i) for i in range(20)])
    bad = spark.range(1).select(F.lit("k1").alias("k"), F.raise_error(F.lit("no")).cast("int").alias("v"))
    with pytest.raises(PySparkException):
        table.update(bad)
    assert {r.k: r.v for r in table.load().collect()} == {f"k{i}": i for i in range(20)}
    (tmp_path / "t" / "manifest-000000000001.json").write_text(json.dumps({"number": 1, "buckets": 2, "folders": {}}))
    table._manifests = lambda: [json.loads((tmp_path / "t" / "manifest-000000000000.json").read_text())]
    with pytest.raises(RuntimeError, match="another writer"):
        put(spark, table, [("k1", 5)])


def test_stream_stops_at_a_bucket_that_it_cannot_read(spark, tmp_path):
    """What such a bucket held is never saved as missing; batches of other buckets go on."""
    feed, store, marks = tmp_path / "feed", tmp_path / "cache", tmp_path / "marks"
    files = [(i, f"f{i}.py", f"p.f{i}", 1.0, 20, f"def f{i}():\n    pass\n".encode()) for i in range(12)]

    def follow(rows):
        spark.createDataFrame(rows, FEED).write.mode("append").parquet(str(feed))
        incremental.follow(spark.readStream.schema(FEED).parquet(str(feed)), str(store), str(marks), buckets=4).awaitTermination()

    follow(files)
    first = {p.parent.name: p for p in store.glob("data-*/bucket=*/*.parquet")}
    bucket = {r.rel_file_path: r.b for r in cache.load(spark, str(store)).select("rel_file_path", F.pmod(F.xxhash64("rel_file_path"), F.lit(4)).alias("b")).collect()}
    lost = bucket["f0.py"]
    whole = first[f"bucket={lost}"].read_bytes()
    first[f"bucket={lost}"].write_bytes(b"no Parquet")
    other = next(i for i in range(12) if bucket[f"f{i}.py"] != lost)
    follow([(other, f"f{other}.py", f"p.f{other}", 2.0, 20, b"def newer():\n    pass\n")])
    with pytest.raises(PySparkException):
        follow([(0, "f0.py", "p.f0", 2.0, 20, b"def newest():\n    pass\n")])
    (first[f"bucket={lost}"].parent / f".{first[f'bucket={lost}'].name}.crc").unlink(missing_ok=True)
    first[f"bucket={lost}"].write_bytes(whole)
    incremental.follow(spark.readStream.schema(FEED).parquet(str(feed)), str(store), str(marks), buckets=4).awaitTermination()
    names = {r.id for r in extract.nodes(cache.load(spark, str(store))).where("kind = 'function'").collect()}
    assert names == {f"p.f{i}.f{i}" for i in range(12) if i not in (0, other)} | {f"p.f{other}.newer", "p.f0.newest"}


NODES = "node_seq long, id string, name string, kind string, module string, file_path string, lineno int, end_lineno int, parent_id string, docstring string"


def small(spark):
    rows = [(0, "m", "m", "module", "m", "m.py", 1, 9, None, None), (1, "m.A", "A", "class", "m", "m.py", 1, 9, "m", "d"), (2, "n", "n", "module", "n", "n.py", 1, 9, None, None)]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(0, "m", "m.A", "defines")], "edge_seq long, source string, target string, type string")


def test_fingerprint_key(spark):
    """File, evidence, root and model tell graphs apart; lines, docstrings and parents do not."""
    nodes, edges = small(spark)
    found = spark.createDataFrame([("Observer", "m.A", "loops")], "pattern string, symbol_id string, evidence string")
    one = graph.fingerprint(nodes, edges, found).first()[0]
    moved = nodes.withColumn("file_path", F.when(F.col("id") == "n", "o.py").otherwise(F.col("file_path")))
    others = [graph.fingerprint(moved, edges, found), graph.fingerprint(nodes, edges, found.withColumn("evidence", F.lit("x"))), graph.fingerprint(nodes, edges, found, root="/a"), graph.fingerprint(nodes, edges, found, key="a"), graph.fingerprint(nodes, edges, found, "a", "b"), graph.fingerprint(nodes, edges, found, "ab"), graph.fingerprint(nodes.unionByName(nodes.where("id = 'n'")), edges, found)]
    assert len({one, *(o.first()[0] for o in others)}) == 8
    assert one == graph.fingerprint(nodes.withColumns({"lineno": F.lit(5), "docstring": F.lit("x"), "parent_id": F.lit("p")}), edges, found).first()[0]
    before, after = graph.file_digests(nodes, edges, found), graph.file_digests(moved, edges, found)
    assert sorted(r.file_path for r in graph.changed_files(before, after).collect()) == ["n.py", "o.py"]
    # sums of the files that stayed and of those that changed are those of the graph
    changed = graph.changed_files(before, after)
    joined = before.join(changed, "file_path", "left_anti").unionByName(after.join(changed, "file_path", "left_semi"))
    assert graph.digests_fingerprint(joined).first() == graph.fingerprint(moved, edges, found).first()


def test_replies_outlive_the_driver(spark, tmp_path):
    nodes, edges = small(spark)
    reply = json.dumps({"components": [], "narrative": "t"})
    asked = []

    def ask(system, text):
        asked.append(text)
        return reply

    for _ in range(2):
        kept = reconcile.ClusteringCache(spark, f"{tmp_path}/replies")  # as a new driver would
        assert reconcile.cluster(spark, nodes, edges, ask, kept, root="/a").first().reply == reply
        assert len(asked) == 1 and len(kept) == 1
    reconcile.cluster(spark, nodes.withColumn("file_path", F.lit("x.py")), edges, ask, kept, root="/a")
    reconcile.cluster(spark, nodes, edges, ask, kept, root="/b")
    reconcile.cluster(spark, nodes, edges, ask, kept, root="/a", refresh=True)
    assert len(asked) == 4 and len(kept) == 3
    kept.clear()
    assert len(kept) == 0


def test_members_are_stripped_of_all_white_space(spark):
    nodes, _ = small(spark)
    body = {"components": [{"component_id": " c\n", "name": "n", "member_symbol_ids": ["\tm.A\n", "\u00a0n\u2003", "m .A"], "role": "r", "rationale": "x"}], "unclustered_symbol_ids": ["\r\nm\v", "gone\t"], "narrative": "t"}
    replies = spark.createDataFrame([(0, json.dumps(body))], "clustering_id int, reply string")
    assert sorted(r.symbol_id for r in reconcile.valid_members(replies, nodes).collect()) == ["m.A", "n"]
    assert [(r.part, r.symbol_id) for r in reconcile.dropped(replies, nodes).orderBy("part").collect()] == [(0, "m .A"), (1, "gone")]


def test_settings_in_a_new_folder(tmp_path):
    assert settings.save(f"{tmp_path}/a/b/c.json", {"x": 1})["x"] == 1
    records = settings.load_registry(f"{tmp_path}/d/models.json", f"{tmp_path}/a/b/c.json")
    assert settings.load_registry(f"{tmp_path}/d/models.json", f"{tmp_path}/none.json") == records


def test_large_rows_lie_in_small_row_groups(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k string, v array<string>", "k", buckets=2)
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(160)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), F.lit("."), i.cast("string")), 256)).alias("v"))
    table.update(rows)
    groups = [m.row_group(i) for p in (tmp_path / "t").glob("data-*/bucket=*/*.parquet") for m in [pq.ParquetFile(p).metadata] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 3000 and max(g.total_byte_size for g in groups) < 10 << 20
    assert table.load().selectExpr("count(DISTINCT k)", "sum(size(v))").first()[:] == (3000, 3000 * 160)
