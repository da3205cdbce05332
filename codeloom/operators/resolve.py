"""Stage B: names become edges by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .extract import exploded, nodes, sequence
from .graph import dedupe_edges

#: Order of edges: the kinds of edges that precede others take a lower block of edge_seq.
_BLOCK = 1 << 60


def _seq(block: int, file_seq: Column, pos: Column) -> Column:
    return F.lit(block * _BLOCK) + sequence(file_seq, pos)


def registry(all_nodes: DataFrame, kind: str) -> DataFrame:
    """short, id, seq, held (entries of that short name) of the nodes of a kind; repeated ids are entries of their own."""
    own = all_nodes.where(F.col("kind") == kind).select(F.col("name").alias("short"), "id", F.col("node_seq").alias("seq"))
    counts = own.groupBy(F.col("short").alias("s")).agg(F.count(F.lit(1)).alias("held"))
    return own.join(counts, F.col("short") == F.col("s")).drop("s")


def inherits(a: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id, file_seq, at (place among the file's bases), base_id: a base is the class of that name in the module, else the class with that full id, else the only class of that short name."""
    bases = exploded(a, "bases").withColumn("local", F.concat("file_module", F.lit("."), "base_name"))
    full = classes.select("id").distinct()
    sole = classes.where("held = 1").select(F.col("short").alias("sole_name"), F.col("id").alias("sole_id"))
    found = (
        bases.join(full.select(F.col("id").alias("local_id")), F.col("local") == F.col("local_id"), "left")
        .join(full.select(F.col("id").alias("full_id")), F.col("base_name") == F.col("full_id"), "left")
        .join(sole, F.col("base_name") == F.col("sole_name"), "left")
        .withColumn("base_id", F.coalesce("local_id", "full_id", "sole_id"))
    )
    return found.where("base_id IS NOT NULL").select("class_id", "file_seq", "at", "base_id")


def first_by_prefix(known: DataFrame) -> DataFrame:
    """short, prefix, id: of the symbols of a short name whose id starts with a prefix and a dot, the first by seq. A row for each dot of an id at most."""
    dots = F.size(F.split("id", "[.]")) - 1
    below = known.where(dots > 0).select("short", "id", "seq", F.explode(F.sequence(F.lit(1), dots)).alias("k"))
    return below.withColumn("prefix", F.expr("substring_index(id, '.', k)")).groupBy("short", "prefix").agg(F.min_by("id", "seq").alias("id"))


def named(names: DataFrame, known: DataFrame) -> DataFrame:
    """module, name, id of the (module, name) pairs that mean a known symbol: a full id; else, of a short name, the first whose id starts with the module and a dot, else the only one.

    All are equality joins in which a pair meets one row at most, however many symbols share a short name.
    """
    pairs = names.select("module", "name").distinct()
    full = known.select(F.col("id").alias("full_id")).distinct()
    here = first_by_prefix(known).select(F.col("short").alias("here_name"), F.col("prefix").alias("here_module"), F.col("id").alias("here_id"))
    sole = known.where("held = 1").select(F.col("short").alias("sole_name"), F.col("id").alias("sole_id"))
    found = (
        pairs.join(full, (F.col("name") == F.col("full_id")) & F.col("name").contains("."), "left")
        .join(here, (F.col("name") == F.col("here_name")) & (F.col("module") == F.col("here_module")), "left")
        .join(sole, F.col("name") == F.col("sole_name"), "left")
    )
    return found.select("module", "name", F.coalesce("full_id", "here_id", "sole_id").alias("id")).where("id IS NOT NULL")


def ancestors(inherited: DataFrame, of: DataFrame) -> DataFrame:
    """class_id, ancestor_id, path of the classes in of (class_id): themselves and what they inherit from, in the order of a depth-first search by path.

    Of the paths from a class to an ancestor only the least is kept, and corrected when a later round finds a lesser one: what a depth-first search
    visits, it visits by the least path without a class twice, and the part of that path before its end is the least path to the class before. So there
    is a row for each class and ancestor, not for each path, and a round for each step of the longest such path. A cycle ends a path.
    """
    step = inherited.groupBy(F.col("class_id").alias("child"), "base_id").agg(F.min(F.array(F.col("file_seq").cast("bigint"), F.col("at").cast("bigint"))).alias("place"))
    best = of.select("class_id").distinct().select("class_id", F.col("class_id").alias("ancestor_id"), F.array().cast("array<bigint>").alias("path"), F.array("class_id").alias("through"), F.lit(True).alias("fresh"))
    while True:
        fresh = best.where("fresh").join(step, F.col("ancestor_id") == F.col("child")).where(~F.array_contains("through", F.col("base_id")))
        fresh = fresh.select("class_id", F.col("base_id").alias("ancestor_id"), F.concat("path", "place").alias("path"), F.concat("through", F.array("base_id")).alias("through"), F.lit(True).alias("fresh"))
        # of equal paths, the one of an earlier round
        least = best.withColumn("fresh", F.lit(False)).unionByName(fresh).groupBy("class_id", "ancestor_id").agg(F.min(F.struct("path", "fresh", "through")).alias("least"))
        best = cut(least.select("class_id", "ancestor_id", "least.path", "least.through", "least.fresh"))
        if best.where("fresh").isEmpty():
            return best.select("class_id", "ancestor_id", "path")


def methods_of(wanted: DataFrame, inherited: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """class_id, attr, method_id of the (class_id, attr) pairs: the class's own method, else the first one that a depth-first search of its bases finds."""
    pairs = wanted.select("class_id", "attr").distinct()
    known = all_nodes.where("kind = 'method'").select(F.col("id").alias("method_id")).distinct()
    tried = pairs.join(ancestors(inherited, pairs), "class_id").withColumn("method", F.concat("ancestor_id", F.lit("."), "attr"))
    return tried.join(known, F.col("method") == F.col("method_id")).groupBy("class_id", "attr").agg(F.min_by("method_id", "path").alias("method_id"))


def resolve(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of STAGE_A rows."""
    all_nodes = nodes(a)
    classes, functions = registry(all_nodes, "class"), registry(all_nodes, "function")
    inherited = cut(inherits(a, classes))
    defines = all_nodes.where("parent_id IS NOT NULL").select(F.col("node_seq").alias("edge_seq"), F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("defines").alias("type"))
    extends = inherited.select(_seq(1, F.col("file_seq"), F.col("at")).alias("edge_seq"), F.col("class_id").alias("source"), F.col("base_id").alias("target"), F.lit("inherits").alias("type"))

    calls, assigns = exploded(a, "calls"), exploded(a, "assigns")
    said = calls.where("type = 'call'").select(F.col("file_module").alias("module"), F.col("called_name").alias("name"))
    class_of = named(said.unionByName(assigns.select(F.col("file_module").alias("module"), F.col("called_name").alias("name"))), classes)
    function_of = named(said, functions)
    on = lambda table, id_: table.select(F.col("module").alias("file_module"), F.col("name").alias("called_name"), F.col("id").alias(id_))
    plain = calls.where("type = 'call'").join(on(class_of, "class_id"), ["file_module", "called_name"], "left").join(on(function_of, "function_id"), ["file_module", "called_name"], "left")
    plain = plain.select("file_seq", "call_pos", "callable_id", F.coalesce("class_id", "function_id").alias("target"), F.when(F.col("class_id").isNotNull(), "constructs").otherwise("calls").alias("type")).where("target IS NOT NULL")

    # a variable has the class of the last assignment that constructs one
    typed = assigns.join(on(class_of, "class_id"), ["file_module", "called_name"]).groupBy("file_seq", "callable_pos", F.col("target").alias("var_name")).agg(F.max_by("class_id", "assign_pos").alias("var_class"))
    attributes = calls.where("type = 'attr_call'").join(typed, ["file_seq", "callable_pos", "var_name"], "left")
    own = (F.col("var_name") == "self") & F.col("enclosing_class_id").isNotNull()
    attributes = attributes.withColumn("class_id", F.when(own, F.col("enclosing_class_id")).otherwise(F.col("var_class"))).where("class_id IS NOT NULL").withColumnRenamed("attr_name", "attr")
    found = methods_of(attributes, inherited, all_nodes)
    member = attributes.join(found, ["class_id", "attr"]).select("file_seq", "call_pos", "callable_id", F.col("method_id").alias("target"), F.lit("calls").alias("type"))

    used = plain.unionByName(member).select(_seq(2, F.col("file_seq"), F.col("call_pos")).alias("edge_seq"), F.col("callable_id").alias("source"), "target", "type")
    return all_nodes, dedupe_edges(defines.unionByName(extends).unionByName(used))
