"""Stage A: what each source file tells on its own. Names stay unresolved; joins resolve them later. Nothing is run or imported."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..model import STAGE_A

#: What is said of a match.
EVIDENCE = {
    "Singleton": "__new__ guards and returns a cached class-level instance",
    "Factory": "returns different constructed types across conditional branches",
    "Observer": "iterates a self-owned collection and invokes a method on each element",
}
#: Bytes of source that are parsed before a worker hands on what they tell.
PORTION = 1 << 18
_CALLABLE = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPE = (*_CALLABLE, ast.ClassDef)


def module_path(path: Column, root_name: Column) -> Column:
    """a/b.py as a.b, a/__init__.py as a, __init__.py as the root's name."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    stem = F.regexp_replace(stem, r"(^|/)__init__$", "")
    return F.when(stem == "", root_name).otherwise(F.replace(stem, F.lit("/"), F.lit(".")))


def path_key(path: Column) -> Column:
    """Sorts paths part by part."""
    return F.split(path, "/")


def inner(node: ast.AST) -> Iterator[ast.AST]:
    """The nodes below, depth first in source order, without nested functions and classes and what they hold, and without those that have no fields (pass, load, store)."""
    waiting = [node]
    while waiting:
        at = waiting.pop()
        if at is not node:
            yield at
        for name in reversed(at._fields):
            held = getattr(at, name, None)
            for n in reversed(held) if held.__class__ is list else (held,):
                if isinstance(n, ast.AST) and n._fields and not isinstance(n, _SCOPE):
                    waiting.append(n)


def dotted(node: ast.AST) -> str | None:
    """a.b.c of names and attributes; of attributes of something else, the attributes alone."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.append(node.id)
    return ".".join(reversed(names)) or None


def attribute_of(node: ast.AST | None, owners: set[str]) -> str | None:
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id in owners:
        return node.attr
    return None


def is_singleton(cls: ast.ClassDef) -> bool:
    """Its first __new__ has an if that compares an attribute of the class with None, sets it below, and returns it somewhere."""
    new = next((s for s in cls.body if isinstance(s, _CALLABLE) and s.name == "__new__"), None)
    if new is None:
        return False
    owners = {cls.name, new.args.args[0].arg if new.args.args else "cls"}
    is_none = lambda n: isinstance(n, ast.Constant) and n.value is None

    def guarded(test: ast.AST) -> str | None:
        if isinstance(test, ast.Compare):
            for op, right in zip(test.ops, test.comparators):
                if isinstance(op, (ast.Is, ast.Eq)):
                    name = attribute_of(test.left, owners) if is_none(right) else attribute_of(right, owners) if is_none(test.left) else None
                    if name:
                        return name
        return None

    guard = next(((n, name) for n in inner(new) if isinstance(n, ast.If) and (name := guarded(n.test))), None)
    if guard is None:
        return False
    targets = [t for n in inner(guard[0]) if isinstance(n, (ast.Assign, ast.AnnAssign)) for t in (n.targets if isinstance(n, ast.Assign) else [n.target])]
    returned = [n.value for n in inner(new) if isinstance(n, ast.Return)]
    return any(attribute_of(t, owners) == guard[1] for t in targets) and any(attribute_of(v, owners) == guard[1] for v in returned)


def is_observer(cls: ast.ClassDef) -> bool:
    """A method loops over an attribute of self and calls a method of what the loop yields."""
    for loop in (n for s in cls.body if isinstance(s, _CALLABLE) for n in inner(s) if isinstance(n, ast.For) and attribute_of(n.iter, {"self"})):
        yielded = {n.id for n in ast.walk(loop.target) if isinstance(n, ast.Name)}
        if any(isinstance(n, ast.Call) and attribute_of(n.func, yielded) for n in inner(loop)):
            return True
    return False


def chains(held: list[ast.AST]) -> Iterator[tuple[int, int, str]]:
    """(number of the if chain, number of its branch, dotted name) of each `return Name(...)` of a callable that holds these nodes; chains of one branch have none."""
    for chain, first in enumerate(n for n in held if isinstance(n, ast.If)):
        bodies, here = [first.body], first
        while len(here.orelse) == 1 and isinstance(here.orelse[0], ast.If):
            here = here.orelse[0]
            bodies.append(here.body)
        if here.orelse:
            bodies.append(here.orelse)
        if len(bodies) > 1:
            for branch, body in enumerate(bodies):
                for found in (n for s in body for n in ([s] if isinstance(s, ast.Return) else inner(s)) if isinstance(n, ast.Return)):
                    name = dotted(found.value.func) if isinstance(found.value, ast.Call) else None
                    if name:
                        yield chain, branch, name


def decode(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse(path: str, module: str, source: str | bytes | None) -> dict:
    """A file's row of STAGE_A, without file_seq. On any error there are no nodes, and error says why."""
    out: dict = {"rel_file_path": path, "module_path": module, "error": None, "nodes": [], "bases": [], "assigns": [], "calls": [], "patterns": [], "branches": []}
    try:
        text = decode(source) if isinstance(source, (bytes, bytearray)) else source or ""
        _read(out, ast.parse(text), text)
    except SyntaxError as e:
        out["error"] = f"SyntaxError: {e.msg} at line {e.lineno}"
    except Exception as e:  # a parser that gives up, with MemoryError, RecursionError or ValueError
        out["error"] = str(e) or type(e).__name__
    if out["error"] is not None:
        out.update({k: [] for k in ("nodes", "bases", "assigns", "calls", "patterns", "branches")})
    return out


def _read(out: dict, tree: ast.Module, text: str) -> None:
    path, module = out["rel_file_path"], out["module_path"]

    def node(symbol: str, name: str, kind: str, of: ast.AST, parent: str | None, span: tuple[int, int]) -> int:
        out["nodes"].append({"pos": len(out["nodes"]), "id": symbol, "name": name, "kind": kind, "module": module, "file_path": path, "lineno": span[0], "end_lineno": span[1], "parent_id": parent, "docstring": ast.get_docstring(of)})
        return len(out["nodes"]) - 1

    def callable_(fn: ast.AST, owner: str, cls: str | None) -> None:
        symbol = f"{owner}.{fn.name}"
        pos = node(symbol, fn.name, "method" if cls else "function", fn, owner, (fn.lineno, fn.end_lineno or fn.lineno))
        mine = {"callable_pos": pos, "callable_id": symbol}
        held = list(inner(fn))
        for n in held:
            if isinstance(n, (ast.Assign, ast.AnnAssign, ast.NamedExpr)) and isinstance(n.value, ast.Call):
                called = dotted(n.value.func)
                for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if called and isinstance(target, ast.Name):
                        out["assigns"].append({**mine, "assign_pos": len(out["assigns"]), "target": target.id, "called_name": called})
            elif isinstance(n, ast.Call):
                said = {**mine, "enclosing_class_id": cls, "called_name": None, "var_name": None, "attr_name": None}
                if called := dotted(n.func):
                    out["calls"].append({**said, "call_pos": len(out["calls"]), "type": "call", "called_name": called})
                if isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name):
                    out["calls"].append({**said, "call_pos": len(out["calls"]), "type": "attr_call", "var_name": n.func.value.id, "attr_name": n.func.attr})
        out["branches"] += [{"pos": pos, "symbol_id": symbol, "chain_no": c, "branch_no": b, "dotted": d, "short": d.rpartition(".")[2]} for c, b, d in chains(held)]

    node(module, module.rpartition(".")[2], "module", tree, None, (1, max(1, len(text.splitlines()))))
    for statement in tree.body:
        if isinstance(statement, _CALLABLE):
            callable_(statement, module, None)
        elif isinstance(statement, ast.ClassDef):
            symbol = f"{module}.{statement.name}"
            pos = node(symbol, statement.name, "class", statement, module, (statement.lineno, statement.end_lineno or statement.lineno))
            names = [name for base in statement.bases if (name := dotted(base))]
            out["bases"] += [{"class_pos": pos, "class_id": symbol, "base_pos": i, "base_name": name} for i, name in enumerate(names)]
            for kind, holds in (("Singleton", is_singleton), ("Observer", is_observer)):
                if holds(statement):
                    out["patterns"].append({"pos": pos, "pattern": kind, "symbol_id": symbol})
            for item in statement.body:
                if isinstance(item, _CALLABLE):
                    callable_(item, symbol, symbol)


def portions(sizes: Iterable[int | None], most: int = PORTION) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows that have `most` bytes together at most; a larger row stands alone. A row counts 64 bytes at least."""
    first = last = held = 0
    for last, size in enumerate(sizes):
        size = max(size or 0, 64)
        if last > first and held + size > most:
            yield first, last - first
            first, held = last, 0
        held += size
    if held:
        yield first, last + 1 - first


def stage_a(files: DataFrame) -> DataFrame:
    """STAGE_A rows of files (file_seq, rel_file_path, module_path, content: string or binary). A worker holds what a portion of source tells, not what a batch of files does."""
    schema = to_arrow_schema(StructType.fromDDL(STAGE_A))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, number in portions(pc.binary_length(batch.column("content")).to_pylist()):
                rows = [{"file_seq": f["file_seq"], **parse(f["rel_file_path"], f["module_path"], f["content"])} for f in batch.slice(first, number).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select(F.col("file_seq").cast("long").alias("file_seq"), "rel_file_path", "module_path", "content").mapInArrow(run, STAGE_A)


#: Rows of a file and files that a sequence number has room for, below the kinds of edges.
PER_FILE, FILES = 1 << 28, 1 << 32


def sequence(file_seq: Column, pos: Column) -> Column:
    """A number that orders rows by file and place; an error, not another row's number, where there is no room."""
    fits = (file_seq >= 0) & (file_seq < FILES) & (pos < PER_FILE)
    return F.when(fits, file_seq * PER_FILE + pos).otherwise(F.raise_error(F.lit("a file or a row of it has no room in the sequence numbers")).cast("long"))


def exploded(a: DataFrame, column: str) -> DataFrame:
    """One row per element of a list column of STAGE_A, with its place `at` in the list and the file's columns file_seq and module_path."""
    return a.select("file_seq", F.col("module_path").alias("file_module"), F.posexplode(column).alias("at", "x")).select("file_seq", "file_module", "at", "x.*")


def nodes(a: DataFrame) -> DataFrame:
    return exploded(a, "nodes").select(sequence(F.col("file_seq"), F.col("pos")).alias("node_seq"), "id", "name", "kind", "module", "file_path", "lineno", "end_lineno", "parent_id", "docstring")


def errors(a: DataFrame) -> DataFrame:
    return a.where("error IS NOT NULL").select(F.col("rel_file_path").alias("file_path"), F.col("error").alias("message"))
