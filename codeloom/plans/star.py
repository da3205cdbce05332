"""A graph and a source corpus derived from the driver's relational tables. Adapters for queries, not claims about the data."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import module_path, stage_a
from ..operators.graph import dedupe_edges

#: Room for keys in a kind's block of sequence numbers.
BLOCK = 10**18
#: Suppliers and customers of one rendered file.
SUPPLIERS, CUSTOMERS = 100, 1000
#: Fixed value: the nation whose supplier files do not parse.
BROKEN = 24


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as modules, nations as classes, suppliers and customers as methods, parts and orders as functions."""
    region, nation, supplier, customer, part, orders = read(spark, sf_dir, "region", "nation", "supplier", "customer", "part", "orders")
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    # regions and nations are fixed lists
    places = nation.select(F.col("n_nationkey").alias("k"), F.concat(key("R", "n_regionkey"), F.lit("."), key("N", "n_nationkey")).alias("nation_id"), key("R", "n_regionkey").alias("module"))

    def rows(df: DataFrame, block: int, seq: str, id_: Column, name: Column, kind: str, module: Column, parent: Column, line: Column) -> DataFrame:
        return df.select((F.lit(block * BLOCK) + F.col(seq)).alias("node_seq"), id_.alias("id"), name.alias("name"), F.lit(kind).alias("kind"), module.alias("module"), F.concat(module, F.lit(".py")).alias("file_path"), line.cast("int").alias("lineno"), (line + 4).cast("int").alias("end_lineno"), parent.alias("parent_id"), F.lit(None).cast("string").alias("docstring"))

    none, one = F.lit(None).cast("string"), F.lit(1)
    out = rows(region, 0, "r_regionkey", key("R", "r_regionkey"), F.col("r_name"), "module", key("R", "r_regionkey"), none, one)
    out = out.unionByName(rows(nation, 1, "n_nationkey", F.concat(key("R", "n_regionkey"), F.lit("."), key("N", "n_nationkey")), F.col("n_name"), "class", key("R", "n_regionkey"), key("R", "n_regionkey"), F.col("n_nationkey") * 10 + 1))
    for block, df, k, n, place, letter in ((2, supplier, "s_suppkey", "s_name", "s_nationkey", "S"), (3, customer, "c_custkey", "c_name", "c_nationkey", "C")):
        held = df.join(places, F.col(place) == F.col("k"))
        out = out.unionByName(rows(held, block, k, F.concat("nation_id", F.lit("."), key(letter, k)), F.col(n), "method", F.col("module"), F.col("nation_id"), F.col(k)))
    out = out.unionByName(rows(part, 4, "p_partkey", key("P.", "p_partkey"), F.col("p_name"), "function", F.lit("P"), none, F.col("p_partkey")))
    return out.unionByName(rows(orders, 5, "o_orderkey", key("O.", "o_orderkey"), key("order ", "o_orderkey"), "function", F.lit("O"), none, F.col("o_orderkey")))


def star_edges(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Regions define nations, and they suppliers and customers; orders call parts; parts construct suppliers; customers inherit orders. Of repeats, the first."""
    nation, supplier, customer, orders, lineitem = read(spark, sf_dir, "nation", "supplier", "customer", "orders", "lineitem")
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nation_id = F.concat(key("R", "n_regionkey"), F.lit("."), key("N", "n_nationkey"))
    places = nation.select(F.col("n_nationkey").alias("k"), nation_id.alias("nation_id"))
    edge = lambda df, block, seq, source, target, kind: df.select((F.lit(block * BLOCK) + seq).alias("edge_seq"), source.alias("source"), target.alias("target"), F.lit(kind).alias("type"))
    supplier_id = supplier.join(places, F.col("s_nationkey") == F.col("k")).select("s_suppkey", "nation_id", F.concat("nation_id", key(".S", "s_suppkey")).alias("supplier_id"))
    customer_id = customer.join(places, F.col("c_nationkey") == F.col("k")).select("c_custkey", "nation_id", F.concat("nation_id", key(".C", "c_custkey")).alias("customer_id"))
    out = edge(nation, 1, F.col("n_nationkey"), key("R", "n_regionkey"), nation_id, "defines")
    out = out.unionByName(edge(supplier_id, 2, F.col("s_suppkey"), F.col("nation_id"), F.col("supplier_id"), "defines"))
    out = out.unionByName(edge(customer_id, 3, F.col("c_custkey"), F.col("nation_id"), F.col("customer_id"), "defines"))
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    out = out.unionByName(edge(lineitem, 4, line, key("O.", "l_orderkey"), key("P.", "l_partkey"), "calls"))
    out = out.unionByName(edge(lineitem.join(supplier_id, F.col("l_suppkey") == F.col("s_suppkey")), 5, line, key("P.", "l_partkey"), F.col("supplier_id"), "constructs"))
    out = out.unionByName(edge(orders.join(customer_id, F.col("o_custkey") == F.col("c_custkey")), 6, F.col("o_orderkey"), F.col("customer_id"), key("O.", "o_orderkey"), "inherits"))
    return dedupe_edges(out) if distinct else out


def _block(strings: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """The texts of each key, in order; a key's rows are bounded by the block sizes."""
    return strings.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "").alias("content"))


def rendered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_seq, rel_file_path, module_path, content: Python source written from the tables.

    r{r}/n{n}/__init__.py: helper() and lead(), which calls it; the region's base class in its nation of the lowest key; by n div 5 the code of a pattern (0 singleton,
    1 factory, 2 observer) or near misses (3). r{r}/n{n}/supply_{b}.py: classes Supplier_{k}(Base_{r}) with ship(), which calls self.bill() and the
    inherited self.audit(); those of nation BROKEN end in a broken line. r{r}/n{n}/buy_{b}.py: functions customer_{k}() that call helper(), construct the customer's
    three suppliers of the lowest keys and call ship() on each.
    """
    nation, supplier, customer, orders, lineitem = read(spark, sf_dir, "nation", "supplier", "customer", "orders", "lineitem")
    text = lambda c: F.col(c).cast("string")
    base = F.concat(F.lit("class Base_"), text("n_regionkey"), F.lit(":\n    def audit(self):\n        return 1\n\n\n"))
    least = nation.groupBy(F.col("n_regionkey").alias("r")).agg(F.min("n_nationkey").alias("least"))
    code = F.when(F.expr("n_nationkey div 5") == 0, F.lit("class Registry:\n    _one = None\n\n    def __new__(cls):\n        if cls._one is None:\n            cls._one = object.__new__(cls)\n        return cls._one\n"))
    code = code.when(F.expr("n_nationkey div 5") == 1, F.lit("class Round:\n    pass\n\n\nclass Square:\n    pass\n\n\ndef make(kind):\n    if kind == 1:\n        return Round()\n    elif kind == 2:\n        return Square()\n    return None\n"))
    code = code.when(F.expr("n_nationkey div 5") == 2, F.lit("class Board:\n    def tell(self):\n        for one in self.ones:\n            one.update()\n"))
    code = code.when(F.expr("n_nationkey div 5") == 3, F.lit("class Same:\n    def tell(self, ones):\n        for one in ones:\n            one.update()\n\n\ndef same(kind):\n    if kind:\n        return Same()\n    else:\n        return Same()\n"))
    files = nation.join(least, F.col("n_regionkey") == F.col("r")).select("n_nationkey", "n_regionkey", F.lit("__init__").alias("file"), F.concat(F.when(F.col("n_nationkey") == F.col("least"), base).otherwise(""), F.lit("def helper():\n    return 2\n\n\ndef lead():\n    \"\"\"Calls its neighbour.\"\"\"\n    return helper()\n\n\n"), F.coalesce(code, F.lit(""))).alias("content"))

    held = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    shop = F.concat(F.lit("class Supplier_"), text("s_suppkey"), F.lit("(Base_"), text("n_regionkey"), F.lit("):\n    def ship(self):\n        self.bill()\n        return self.audit()\n\n    def bill(self):\n        return 3\n\n\n"))
    shops = _block(held.select("n_nationkey", "n_regionkey", F.expr(f"s_suppkey div {SUPPLIERS}").alias("b"), "s_suppkey", shop.alias("shop")), ["n_nationkey", "n_regionkey", "b"], "s_suppkey", "shop")
    shops = shops.select("n_nationkey", "n_regionkey", F.concat(F.lit("supply_"), text("b")).alias("file"), F.concat("content", F.when(F.col("n_nationkey") == BROKEN, "def broken(:\n").otherwise("")).alias("content"))

    pairs = orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    three = pairs.groupBy("o_custkey").agg(F.slice(F.sort_array(F.collect_set("l_suppkey")), 1, 3).alias("three"))  # a customer's suppliers
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(three, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("three", F.coalesce("three", F.array().cast("array<bigint>")))
    made = F.array_join(F.transform("three", lambda s, i: F.concat(F.lit("    v"), i.cast("string"), F.lit(" = Supplier_"), s.cast("string"), F.lit("()\n"))), "")
    sent = F.array_join(F.transform("three", lambda s, i: F.concat(F.lit("    v"), i.cast("string"), F.lit(".ship()\n"))), "")
    buy = F.concat(F.lit("def customer_"), text("c_custkey"), F.lit("():\n    helper()\n"), made, sent, F.lit("\n\n"))
    bought = _block(buyers.select("n_nationkey", "n_regionkey", F.expr(f"c_custkey div {CUSTOMERS}").alias("b"), "c_custkey", buy.alias("buy")), ["n_nationkey", "n_regionkey", "b"], "c_custkey", "buy")
    bought = bought.select("n_nationkey", "n_regionkey", F.concat(F.lit("buy_"), text("b")).alias("file"), "content")

    every = files.unionByName(shops).unionByName(bought)
    kind = F.when(F.col("file") == "__init__", 0).when(F.col("file").startswith("supply_"), 1).otherwise(2)
    number = F.coalesce(F.expr("try_cast(split_part(file, '_', 2) AS BIGINT)"), F.lit(0))
    path = F.concat(F.lit("r"), text("n_regionkey"), F.lit("/n"), text("n_nationkey"), F.lit("/"), F.col("file"), F.lit(".py"))
    # files of a nation follow one another; a file's number is its place in the corpus
    return every.select((F.col("n_nationkey").cast("long") * 100_000_000 + kind * 30_000_000 + number).alias("file_seq"), path.alias("rel_file_path"), module_path(path, F.lit("corpus")).alias("module_path"), "content")


def rendered_stage_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_a(rendered_files(spark, sf_dir))


def write_tree(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write a tree of files below a folder that executors see: a Python file per supplier, under its region and nation, of as many spaces as its key has digits.

    By key modulo 10: 1 in a folder to skip; 2 in a hidden folder below; 3 of another suffix; 4 in a package's own file; 5 a name with a dash.
    """
    supplier, nation = read(spark, sf_dir, "supplier", "nation")
    held = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey").cast("string")
    place = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/"))
    m = F.col("s_suppkey") % 10
    name = F.when(m == 1, F.concat(F.lit("__pycache__/s"), k, F.lit(".py"))).when(m == 2, F.concat(F.lit("d/.own/s"), k, F.lit(".py"))).when(m == 3, F.concat(F.lit("s"), k, F.lit(".txt"))).when(m == 4, F.concat(F.lit("p"), k, F.lit("/__init__.py"))).when(m == 5, F.concat(F.lit("p-"), k, F.lit(".py"))).otherwise(F.concat(F.lit("s"), k, F.lit(".py")))
    files = held.select(F.concat(place, name).alias("path"), F.length(k).alias("size"))

    def run(batches):
        for batch in batches:
            for path, size in zip(batch["path"], batch["size"]):
                at = Path(folder, path)
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_text(" " * size)
            yield batch[["path"]]

    files.mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()
