"""Usability survey: scores of answers, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

ITEMS = tuple(f"item{i}" for i in range(1, 11))
RUBRIC = ("contentQuality", "presentationQuality", "usefulness")


def whole(value: Column) -> Column:
    """A JSON value (VARIANT) as a whole number as Python's int() reads it: numbers are cut, booleans count, texts only if they are whole numbers."""
    kind = F.schema_of_variant(value)
    text = F.trim(F.try_variant_get(value, "$", "string"))
    number = F.try_variant_get(value, "$", "double")
    said = F.when(text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("long"))
    cut = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), (F.signum(number) * F.floor(F.abs(number))).try_cast("long"))
    return F.when(kind == "STRING", said).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("long")).otherwise(cut)


def wholes(v: Column, path: str, names: tuple[str, ...]) -> Column:
    """The named fields of an object as an array of whole numbers."""
    fields = F.try_variant_get(v, path, "map<string,variant>")
    return F.transform(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.try_element_at(fields, n)), whole)


def _complete(items: Column, n: int) -> Column:
    return (F.size(items) == n) & F.forall(items, lambda x: F.coalesce(x.between(1, 5), F.lit(False)))


def sus_score(items: Column) -> Column:
    """2.5 times the sum of v - 1 of odd and 5 - v of even items; null if one of the ten is missing or not 1 to 5."""
    parts = F.transform(items, lambda x, i: F.when(i % 2 == 0, x - 1).otherwise(5 - x))
    return F.when(_complete(items, len(ITEMS)), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x) * F.lit(2.5).cast("double"))


def rubric_mean(items: Column) -> Column:
    """The mean; null if one is missing or not 1 to 5."""
    return F.when(_complete(items, len(RUBRIC)), F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x).cast("double") / len(RUBRIC))


def scored(answers: DataFrame) -> DataFrame:
    """participant, condition, sus, rubric of answers (value: a JSON text); texts that are no JSON object are skipped."""
    rows = answers.withColumn("v", F.try_parse_json("value")).where(F.schema_of_variant("v").startswith("OBJECT"))
    field = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    rows = rows.select(field("participantId").alias("participant"), field("condition").alias("condition"), wholes(F.col("v"), "$.sus", ITEMS).alias("items"), wholes(F.col("v"), "$.rubric", RUBRIC).alias("marks"))
    # parsed once: filters and scores below would each take the expressions of all thirteen fields into themselves
    return cut(rows).select("participant", "condition", sus_score(F.col("items")).alias("sus"), rubric_mean(F.col("marks")).alias("rubric"))


def condition_stats(rows: DataFrame) -> DataFrame:
    """condition, n, sus_mean, sus_std, rubric_mean, rubric_std of complete answers: means and population deviations, unrounded."""
    good = rows.where("condition IN ('baseline', 'advanced') AND sus IS NOT NULL AND rubric IS NOT NULL")
    return good.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.avg("sus").alias("sus_mean"), F.stddev_pop("sus").alias("sus_std"), F.avg("rubric").alias("rubric_mean"), F.stddev_pop("rubric").alias("rubric_std"))


def percent_difference(stats: DataFrame) -> DataFrame:
    """One row: by how many percent the rounded means of advanced differ from those of baseline; null without both or from 0."""
    mean = lambda c, m: F.round(F.max(F.when(F.col("condition") == c, F.col(m))), 2)
    pct = lambda m: F.when(mean("baseline", m) != 0, F.round((mean("advanced", m) - mean("baseline", m)) / mean("baseline", m) * 100, 2))
    return stats.agg(pct("sus_mean").alias("sus_pct"), pct("rubric_mean").alias("rubric_pct"))


def report(stats: DataFrame, difference: DataFrame) -> str:
    """The statistics, two rows at most, as Markdown."""
    rows = {r.condition: r for r in stats.collect()}
    out = ["# Usability results", ""]
    show = lambda x: "N/A" if x is None else f"{x:.2f}"
    for condition in ("baseline", "advanced"):
        r = rows.get(condition)
        out += [f"## {condition.capitalize()}", "", "| Measure | Mean | SD |", "|---|---|---|", *(f"| {label} | {show(getattr(r, f'{m}_mean', None))} | {show(getattr(r, f'{m}_std', None))} |" for label, m in (("SUS", "sus"), ("Rubric", "rubric"))), "", f"n = {r.n if r else 0}", ""]
    d = difference.first()
    return "\n".join([*out, f"Difference of SUS means: {show(d.sus_pct)} %", ""])
