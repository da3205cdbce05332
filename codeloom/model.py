"""Schemas of the code graph's tables. Order is part of the meaning: *_seq and *_pos columns carry it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

KINDS = ("module", "class", "function", "method")
EDGE_TYPES = ("inherits", "defines", "constructs", "calls")
#: What change impact follows.
IMPACT_TYPES = ("calls", "constructs", "inherits")

NODE_FIELDS = "id string, name string, kind string, module string, file_path string, lineno int, end_lineno int, parent_id string, docstring string"
NODES = f"node_seq long, {NODE_FIELDS}"
EDGES = "edge_seq long, source string, target string, type string"

#: One row per file: what its syntax tree alone tells.
STAGE_A = (
    "file_seq long, rel_file_path string, module_path string, error string, "
    f"nodes array<struct<pos: int, id: string, name: string, kind: string, module: string, file_path: string, lineno: int, end_lineno: int, parent_id: string, docstring: string>>, "
    "bases array<struct<class_pos: int, class_id: string, base_pos: int, base_name: string>>, "
    "assigns array<struct<callable_pos: int, callable_id: string, assign_pos: int, target: string, called_name: string>>, "
    "calls array<struct<callable_pos: int, callable_id: string, enclosing_class_id: string, call_pos: int, type: string, called_name: string, var_name: string, attr_name: string>>, "
    "patterns array<struct<pos: int, pattern: string, symbol_id: string>>, "
    "branches array<struct<pos: int, symbol_id: string, chain_no: int, branch_no: int, dotted: string, short: string>>"
)


@dataclass
class CodeGraph:
    """The tables of an analysed project."""

    nodes: DataFrame
    edges: DataFrame
    errors: DataFrame
    patterns: DataFrame
    stage_a: DataFrame | None = None
