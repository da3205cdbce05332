"""Coloured source lines: Python's lexer as an automaton over lines, in column expressions.

A line is read from one of five states: in code, or inside a string that an earlier line opened. What a line does to each state is a map of five numbers. Maps
are composed over blocks of lines and then over a file's blocks, so that each block learns its first state and can be coloured by itself.
"""

from __future__ import annotations

import keyword

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import html_escape, lines

#: What an open string of each state begins with; state 0 is code. The letter keeps a quote at a line's start from being taken for part of the opening ones.
OPENED = ("", "'''x", '"""x', "'x", '"x')
#: Lines of a block.
BLOCK = 256
#: Classes of tokens as they are named in HTML.
CLASSES = {"comment": "c", "keyword": "k", "number": "m", "string": "s"}

_LONG = {q: rf"{q * 3}(?:[^{q}\\]|\\.|{q}(?!{q * 2}))*+" for q in "'\""}
_SHORT = {q: rf"{q}(?:[^{q}\\]|\\.)*+" for q in "'\""}
#: A string that is closed, one that goes on behind the line's end (group 1), a comment, a number, a name, white space, a sign. Loops are possessive, so that long lines need no stack.
TOKEN = (
    "(?s)(?:[rRuUbBfFtT]{1,2}(?=['\"]))?+(?:" + "|".join(_LONG[q] + q * 3 for q in "'\"") + "|((?:'''|\"\"\").*+|" + "|".join(_SHORT[q] + r"\\\z" for q in "'\"") + ")|(?!'''|\"\"\")(?:" + "|".join(_SHORT[q] + q for q in "'\"") + "))"
    r"|#.*+|0[xX][0-9a-fA-F_]++|0[bB][01_]++|0[oO][0-7_]++|(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?+|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9][0-9_]*+)?+[jJ]?+|[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Nd}\p{M}\p{Pc}]*+|\s++|."
)


def _after(line: Column, state: int) -> Column:
    """The state behind a line that is read from a state."""
    left = F.element_at(F.regexp_extract_all(F.concat(F.lit(OPENED[state]), line), F.lit(TOKEN), 1), -1)
    return F.when(left.startswith("'''"), 1).when(left.startswith('"""'), 2).when(left.startswith("'"), 3).when(left.startswith('"'), 4).otherwise(0)


def line_map(line: Column) -> Column:
    """The states behind a line, by the state before it. A line without quotes and backslashes keeps long strings open and ends the others."""
    return F.when(line.rlike(r"['\"\\]"), F.array(*[_after(line, s) for s in range(len(OPENED))])).otherwise(F.array(*[F.lit(s) for s in (0, 1, 2, 0, 0)]))


def _then(first: Column, second: Column) -> Column:
    return F.transform(first, lambda s: F.element_at(second, s + 1))


def _ran(maps: Column) -> Column:
    """What maps do, one after the other."""
    return F.aggregate(maps, F.array(*[F.lit(s) for s in range(len(OPENED))]), _then)


def line_states(df: DataFrame, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """key, line_number (from 1), line, state of each line of column text; a null text has no lines, and rows of one key are one file each.

    Blocks of lines are composed apart; of a file, one map a block meets, and the state before each block goes back to it. Line ends are those of
    str.splitlines, each of which ends a string that only a backslash carries on.
    """
    split = lines(F.coalesce(F.col(text), F.lit("")))
    held = df.select(F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"), split.alias("_lines")).where(F.size("_lines") > 0)
    at = F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / block).cast("int"))
    blocks = held.select(key, "_text", F.explode(F.transform(at, lambda b: F.struct(b.alias("b"), F.slice("_lines", b * block + 1, F.lit(block)).alias("rows")))).alias("_b")).select(key, "_text", "_b.b", "_b.rows")
    maps = blocks.select(key, "_text", "b", _ran(F.transform("rows", line_map)).alias("map")).distinct()
    files = maps.groupBy(key, "_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "map"))), lambda x: x["map"]).alias("maps"))
    begun = F.aggregate(F.col("maps"), F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("before")), lambda a, m: F.struct(F.element_at(m, a["now"] + 1).alias("now"), F.concat(a["before"], F.array(a["now"])).alias("before")), lambda a: a["before"])
    starts = files.select(F.col(key).alias("_key"), F.col("_text").alias("_of"), F.posexplode(begun).alias("_at", "_start"))
    met = blocks.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_text") == F.col("_of")) & (F.col("b") == F.col("_at")))
    walked = F.aggregate(
        F.col("rows"), F.struct(F.col("_start").alias("now"), F.array().cast("array<struct<line: string, state: int>>").alias("out")),
        lambda a, x: F.struct(F.element_at(line_map(x), a["now"] + 1).alias("now"), F.concat(a["out"], F.array(F.struct(x.alias("line"), a["now"].alias("state")))).alias("out")), lambda a: a["out"],
    )
    rows = met.select(key, "b", F.posexplode(walked).alias("_i", "_x"))
    return rows.select(key, (F.col("b") * block + F.col("_i") + 1).alias("line_number"), "_x.line", "_x.state")


def tokens(line: Column, state: Column) -> Column:
    """The tokens of a line that is read from a state, in order: an array of (text, kind), which together are the line. kind: string, comment, keyword, number, name, space or sign."""
    opened = F.element_at(F.array(*[F.lit(o) for o in OPENED]), state + 1)
    read = F.regexp_extract_all(F.concat(opened, line), F.lit(TOKEN), 0)
    named = F.transform(
        read,
        lambda t, i: F.struct(
            F.when(i == 0, F.substring(t, F.length(opened) + 1, F.length(t))).otherwise(t).alias("text"),
            F.when(t.rlike("^[a-zA-Z]{0,2}['\"]"), "string").when(t.startswith("#"), "comment").when(t.isin(*keyword.kwlist), "keyword").when(t.rlike(r"^\.?[0-9]"), "number").when(t.rlike(r"^[\p{L}\p{Nl}_]"), "name").when(t.rlike(r"^\s"), "space").otherwise("sign").alias("kind"),
        ),
    )
    return F.filter(named, lambda x: x["text"] != "")


def coloured_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_number, html of each line: HTML that can be linked to, in which comments, keywords, numbers and strings are marked by class.

    A string over several lines is marked in each. Rows of equal key and text are read alike; a null or empty text has no lines. An f-string is one string, with what stands in its braces.
    """
    mark = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    shown = F.transform(tokens(F.col("line"), F.col("state")), lambda t: F.when(t["kind"].isin(*CLASSES), F.concat(F.lit('<span class="'), F.element_at(mark, t["kind"]), F.lit('">'), html_escape(t["text"]), F.lit("</span>"))).otherwise(html_escape(t["text"])))
    number = F.col("line_number").cast("string")
    return line_states(df, key, text).select(key, "line_number", F.concat(F.lit('<span id="line-'), number, F.lit('">'), F.array_join(shown, ""), F.lit("</span>")).alias("html"))


def token_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_number, place (from 0 in the line), kind, text of each token but white space."""
    rows = line_states(df, key, text).select(key, "line_number", F.posexplode(tokens(F.col("line"), F.col("state"))).alias("place", "t"))
    return rows.select(key, "line_number", "place", "t.kind", "t.text").where("kind != 'space'")
