"""Filters, projections and orders of the tables that a viewer shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import ordinals
from ..functions.text import natural_key
from ..model import KINDS


def kind_filter(nodes: DataFrame, shown: dict[str, bool] | None = None) -> DataFrame:
    """The nodes of the kinds that are on; a kind that is not named is on."""
    return nodes.where(F.col("kind").isin([k for k in KINDS if (shown or {}).get(k, True)]))


def _has(text: str, *columns: str) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.col(c)).contains(text.strip().lower())
    return found


def text_filter(nodes: DataFrame, text: str) -> DataFrame:
    """The nodes whose name or id holds the text, in any case."""
    return nodes.where(_has(text, "name", "id"))


def tree_filter(nodes: DataFrame, text: str) -> DataFrame:
    """The nodes whose name holds the text, the methods of such classes, and what stands above them."""
    rows = nodes.withColumn("hit", _has(text, "name"))
    hits = rows.where("hit").select("id", "parent_id", "kind")
    below = rows.where("kind = 'method'").join(hits.where("kind = 'class'").select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    first = hits.select("parent_id").where("parent_id IS NOT NULL").distinct()
    second = nodes.select("id", F.col("parent_id").alias("next")).join(first.withColumnRenamed("parent_id", "id"), "id", "left_semi").where("next IS NOT NULL").select(F.col("next").alias("id"))
    shown = hits.select("id").unionByName(below.select("id")).unionByName(first.select(F.col("parent_id").alias("id"))).unionByName(second).distinct()
    return nodes.join(shown, "id", "left_semi")


def table_rows(nodes: DataFrame) -> DataFrame:
    """node_seq, name, kind, module, file, start, end as the table shows them: a dash for what is missing."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return nodes.select("node_seq", dash("name").alias("name"), dash("kind").alias("kind"), dash("module").alias("module"), dash("file_path").alias("file"), dash("lineno").alias("start"), dash("end_lineno").alias("end"))


def sorted_table(rows: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Rows by a column, numbers by value and texts in natural order; ties by node_seq in either direction."""
    kind = dict(rows.dtypes)[column]
    key = natural_key(F.col(column)) if kind == "string" else F.col(column)
    return rows.orderBy(key.asc() if ascending else key.desc(), "node_seq")


def edge_elements(edges: DataFrame) -> DataFrame:
    """element_id, source, target, type of the drawn edges; idx is an edge's place."""
    return edges.select(F.format_string("e_%d_%s_%s_%s", "edge_seq", "source", "target", "type").alias("element_id"), "source", "target", "type")


def explorer(nodes: DataFrame) -> DataFrame:
    """file_path, n_classes, n_functions, n_methods of each file, and its first place."""
    return nodes.groupBy("file_path").agg(F.min("node_seq").alias("first_seq"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])


#: Children of a page of the explorer.
PAGE = 100


def explorer_tree(nodes: DataFrame, size: int = PAGE) -> DataFrame:
    """file_path, id, kind, page, children (array of node_seq, id, name, kind in order): what each module and class directly holds, in pages of `size`.

    The nested tree of a file is read off its rows from the module down. A symbol without children has one empty page. A row never holds more than a page, whatever
    a symbol holds: a child's place among its parent's comes from counts of ranges, not from a window over the parent.
    """
    held = ordinals(nodes.where("parent_id IS NOT NULL").select("parent_id", "node_seq", "id", "name", "kind"), "parent_id", [F.col("node_seq")], "at")
    page = F.floor(F.col("at") / size).cast("long")
    pages = held.groupBy(F.col("parent_id").alias("of"), page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("node_seq", "id", "name", "kind"))).alias("children"))
    top = nodes.where("kind IN ('module', 'class')").select("file_path", "id", "kind")
    none = F.array().cast("array<struct<node_seq: bigint, id: string, name: string, kind: string>>")
    return top.join(pages, F.col("id") == F.col("of"), "left").select("file_path", "id", "kind", F.coalesce("page", F.lit(0).cast("long")).alias("page"), F.coalesce("children", none).alias("children"))
