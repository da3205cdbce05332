"""Queries over tables of our own against their SQL, where the given tables are too small to show a difference."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from codeloom import queries

GIVEN = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The given tables with 40 suppliers of three nations and keys up to 38,883."""
    folder = tmp_path_factory.mktemp("tables")
    for name in TABLES:
        if name != "supplier":
            (folder / f"{name}.parquet").symlink_to(GIVEN / f"{name}.parquet")
    given = spark.read.parquet(str(GIVEN / "supplier.parquet"))
    wide = given.limit(1).crossJoin(spark.range(40)).withColumns({"s_suppkey": (F.col("id") * 997).cast(given.schema["s_suppkey"].dataType), "s_nationkey": (F.col("id") % 3).cast(given.schema["s_nationkey"].dataType)})
    wide.drop("id").coalesce(1).write.parquet(str(folder / "supplier.parquet"))
    return str(folder)


def by_sql(tables, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet{'/*.parquet' if t == 'supplier' else ''}'")
    found = db.execute(queries.ORACLES[name])
    return [x[0] for x in found.description], found.fetchall()


@pytest.mark.parametrize("name", ["cluster_validate", "cluster_dropped", "cluster_unclustered"])
def test_clusterings_hold_all_suppliers(spark, tables, name):
    columns, want = by_sql(tables, name)
    got = queries.QUERIES[name](spark, tables)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)
    replies = queries._clusterings(spark, tables)
    assert replies.count() == 12 and replies.where("length(reply) > 1000").isEmpty()


def test_numbered_source_of_odd_texts(spark, tmp_path):
    texts = [None, "", "\n", "\n\n", "a", "a\n", "\r\n", "a\r\n\nb\r", "\x85a\u2028\u2029", "a\x0b\x0c\x1c\x1d\x1e\x1f", "a\x00b\n<\"'&>", "é\n😀\n ", " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = db.execute(queries.ORACLES["numbered_source"])
    columns, want = [x[0] for x in found.description], found.fetchall()
    got = sorted(map(tuple, queries.QUERIES["numbered_source"](spark, str(tmp_path)).select(*columns).collect()))
    assert got == sorted(want) and {r[0] for r in got} == set(range(len(texts)))
