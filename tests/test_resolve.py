"""Names and inherited methods against plain searches, and the rows that they take."""

import random
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from codeloom.operators import extract, resolve

KNOWN = "short string, id string, seq long, held long"


def registry(spark, ids):
    held = {}
    for i in ids:
        held[i.rpartition(".")[2]] = held.get(i.rpartition(".")[2], 0) + 1
    return spark.createDataFrame([(i.rpartition(".")[2], i, n, held[i.rpartition(".")[2]]) for n, i in enumerate(ids)], KNOWN)


def plain_name(module, name, ids):
    if "." in name:
        return name if name in ids else None
    same = [i for i in ids if i.rpartition(".")[2] == name]
    return next((i for i in same if i.startswith(module + ".")), same[0] if len(same) == 1 else None)


def test_names(spark):
    rng = random.Random(3)
    modules = ["a", "a.b", "a.b.c", "ab", "b", "b.a", "..", "a."]
    ids = [f"{rng.choice(modules)}.{rng.choice('xyzuvw')}" for _ in range(40)] + ["alone", "a.b.sole", "x"]
    names = [(m, n) for m in [*modules, "", "none"] for n in ["x", "y", "z", "u", "v", "w", "sole", "alone", "a.b.x", "b.y", "gone", "a.gone"]]
    got = {(r.module, r.name): r.id for r in resolve.named(spark.createDataFrame(names * 2, "module string, name string"), registry(spark, ids)).collect()}
    assert got == {(m, n): i for m, n in names if (i := plain_name(m, n, ids)) is not None}


def test_a_short_name_of_many_modules_takes_one_row_a_call(spark):
    """Rows are as many as the prefixes of known ids, and as the names that are looked up; not their product."""
    ids = [f"p{i % 20}.m{i}.helper" for i in range(200)]
    known = registry(spark, ids)
    prefixes = resolve.first_by_prefix(known)
    assert prefixes.count() == 20 + 200
    calls = spark.createDataFrame([(f"p{i % 20}.m{i}", "helper") for i in range(200)], "module string, name string")
    found = resolve.named(calls, known)
    assert sorted(r.id for r in found.collect()) == sorted(ids)
    joins = []

    def walk(plan):
        if plan.nodeName().endswith("Join"):
            joins.append(plan.metrics().apply("numOutputRows").value())
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))
        for inner in ("executedPlan", "plan"):
            if hasattr(plan, inner) and plan.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
                try:
                    walk(getattr(plan, inner)())
                    break
                except Exception:
                    pass

    frame = found._jdf.queryExecution().executedPlan()
    found._jdf.collectToPython()
    walk(frame)
    assert joins and max(joins) <= 200


def depth_first(bases, start):
    """Classes in the order in which a depth-first search of bases visits them."""
    seen = []

    def visit(c):
        if c not in seen:
            seen.append(c)
            for b in bases.get(c, []):
                visit(b)

    visit(start)
    return seen


def inherited(spark, bases):
    rows = [(c, 0, n, b) for n, (c, b) in enumerate((c, b) for c, bs in bases.items() for b in bs)]
    return spark.createDataFrame(rows, "class_id string, file_seq long, at int, base_id string")


@pytest.mark.parametrize("seed", range(3))
def test_ancestors_in_depth_first_order(spark, seed):
    """Random graphs of classes, cycles and repeated bases among them."""
    rng = random.Random(seed)
    bases = {f"c{i}": [f"c{rng.randrange(12)}" for _ in range(rng.choice([0, 1, 2, 2, 3]))] for i in range(12)}
    got = resolve.ancestors(inherited(spark, bases), spark.createDataFrame([(c,) for c in bases], "class_id string")).collect()
    assert len(got) == len({(r.class_id, r.ancestor_id) for r in got})
    for c in bases:
        order = [r.ancestor_id for r in sorted((r for r in got if r.class_id == c), key=lambda r: r.path)]
        assert order == depth_first(bases, c)


def test_diamonds(spark):
    """Thirty stacked diamonds have a thousand million paths, and a row for each ancestor."""
    bases = {}
    for i in range(30):
        bases |= {f"d{i}": [f"l{i}", f"r{i}"], f"l{i}": [f"d{i + 1}"], f"r{i}": [f"d{i + 1}"]}
    began = time.time()
    got = resolve.ancestors(inherited(spark, bases), spark.createDataFrame([("d0",)], "class_id string")).collect()
    assert len(got) == 91 and time.time() - began < 120
    assert [r.ancestor_id for r in sorted(got, key=lambda r: r.path)] == depth_first(bases, "d0")


def test_many_bases_and_sequence_numbers(spark):
    """A class may have more than 64 bases, and a row without room for its number is an error."""
    source = "".join(f"class B{i}:\n    pass\n" for i in range(70)) + f"class C({', '.join(f'B{i}' for i in range(70))}):\n    pass\nclass D(B1):\n    pass\n"
    files = spark.createDataFrame([(0, "m.py", "m", source)], "file_seq long, rel_file_path string, module_path string, content string")
    edges = resolve.resolve(extract.stage_a(files))[1].where("type = 'inherits'").orderBy("edge_seq").collect()
    assert [(r.source, r.target) for r in edges] == [("m.C", f"m.B{i}") for i in range(70)] + [("m.D", "m.B1")]
    assert len({r.edge_seq for r in edges}) == 71
    with pytest.raises(PySparkException, match="no room"):
        spark.range(1).select(extract.sequence(F.lit(1).cast("long"), F.lit(1 << 28))).collect()
