"""Source trees: listed, read and parsed by the executors, which see the folders as the driver does."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import numbered
from ..operators.extract import module_path, path_key
from ..runtime import cut

#: Folders that are not part of a project.
SKIPPED = frozenset((".git", ".venv", "venv", "__pycache__", "build", "dist", ".tox", ".pytest_cache"))
FILES = "file_seq long, rel_file_path string, path string, mtime double, size long"


def resolve_path(path: str | None, roots: tuple[str, ...] = ()) -> Path:
    """The folder or .py file that is meant: an absolute path, or one below the roots or the working folder."""
    said = (path or "").strip()
    if not said:
        raise ValueError("Project path is empty")
    tried = [Path(said)] if os.path.isabs(said) else [Path(r) / said for r in (*roots, os.getcwd())]
    found = next((p.resolve() for p in tried if p.exists()), None)
    if found is None:
        raise FileNotFoundError(f"Project path does not exist: {said}")
    if found.is_file() and found.suffix != ".py":
        raise ValueError(f"Not a Python file: {found}")
    return found


def skipped(part: str) -> bool:
    return part in SKIPPED or part.startswith(".")


#: What a task sees in a folder.
ENTRIES = "rel_file_path string, path string, is_folder boolean, mtime double, size long"


def list_level(folders: DataFrame) -> DataFrame:
    """ENTRIES of the folders (rel_file_path, path): their .py files and the folders to enter, without skipped names. Tasks list; a folder that cannot be listed has no entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rel, path in zip(batch["rel_file_path"], batch["path"]):
                rows = []
                try:
                    with os.scandir(path) as entries:
                        for x in entries:
                            inner = x.is_dir(follow_symlinks=False)
                            if not skipped(x.name) and (inner or (x.name.endswith(".py") and x.is_file())):
                                stat = x.stat()
                                rows.append((f"{rel}/{x.name}" if rel else x.name, x.path, inner, stat.st_mtime, stat.st_size))
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=_ENTRY)
                                    rows = []
                except OSError:
                    pass
                if rows:
                    yield pd.DataFrame(rows, columns=_ENTRY)

    return folders.select("rel_file_path", "path").mapInPandas(run, ENTRIES)


_ENTRY = [f.split()[0] for f in ENTRIES.split(", ")]


def list_files(spark: SparkSession, root: str, absolute_rule: bool = False) -> DataFrame:
    """FILES rows of the .py files below root or of root itself, in order of path parts.

    A round per level of folders: the folders of a level are dealt over tasks, which list them; skipped folders are not entered, nor are links to folders. The
    files of all levels are numbered by ranges of their paths. The driver sees no path but the root. absolute_rule: a skipped name
    above the root hides everything, too.
    """
    base, files = Path(root).resolve(), []
    if base.is_file():
        stat = base.stat()
        files.append(spark.createDataFrame([(base.name, str(base), False, stat.st_mtime, stat.st_size)], ENTRIES))
    elif not (absolute_rule and any(skipped(p) for p in base.parts[1:])):
        level = spark.createDataFrame([("", str(base), True, 0.0, 0)], ENTRIES)
        while not level.isEmpty():
            found = cut(list_level(level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")))
            files.append(found.where("NOT is_folder"))
            level = found.where("is_folder")
    if not files:
        return spark.createDataFrame([], FILES)
    every = reduce(DataFrame.unionByName, files)
    return numbered(every.select("rel_file_path", "path", "mtime", "size"), [path_key(F.col("rel_file_path"))], "file_seq").select("file_seq", "rel_file_path", "path", "mtime", "size")


def scan(spark: SparkSession, root: str, absolute_rule: bool = False) -> tuple[DataFrame, list[tuple[str, str]]]:
    """FILES rows with module_path, and (file_path, message) of a root that is missing or has no files."""
    there = os.path.exists(root)
    files = list_files(spark, root, absolute_rule) if there else spark.createDataFrame([], FILES)
    problems = [] if there and not files.isEmpty() else [(root, f"No .py files found in project directory: {root}" if there else f"Path does not exist: {root}")]
    name = Path(root).resolve().name if Path(root).is_dir() else Path(root).resolve().parent.name
    return files.withColumn("module_path", module_path(F.col("rel_file_path"), F.lit(name))), problems


def read_files(files: DataFrame) -> DataFrame:
    """files with content (binary). Spark's own readers leave out names that begin with an underscore, so tasks open the files; executors need to see them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.iloc[i : i + 64]
                yield part.assign(content=[Path(p).read_bytes() for p in part["path"]])

    return files.mapInPandas(run, f"{FILES}, module_path string, content binary")
