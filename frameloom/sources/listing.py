"""From source expressions to ordered path tables.

Expressions are rows, and every expansion step runs in tasks through the file system
layer of pyarrow, which reads local, HDFS and object-store paths alike. The first levels of
a directory are opened one by one; the sub-directories found there are then walked by
separate tasks. Members of zip archives are paths of their own.
"""

from __future__ import annotations

import fnmatch
import itertools
import os
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.text import SEPARATOR, natural_key, readable_path, tree_key
from frameloom.operators.spread import number_rows, task_count

# The archive suffix and what separates an archive's path from a member's name.
ARCHIVE_SUFFIX = ".zip"
MEMBER_MARK = "!/"
SPREAD_LEVELS = 2
ENTRY_ROWS = 4096  # entries that a task hands on at once

# What opening a bad path or archive can raise (pyarrow reports some as ValueError).
UNREADABLE = (OSError, ValueError, KeyError, zipfile.BadZipFile)

_WILD = re.compile(r"[*?\[]")
_ENTRY = "line_no bigint, part_no int, root string, path string, kind string, length bigint, modified timestamp"
_COLUMNS = ["line_no", "part_no", "root", "path", "kind", "length", "modified"]


def file_system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system that serves a path, the path in its own terms, and the scheme part to put back."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:"), ""
    path = path.rstrip("/")
    uri = "s3://" + path[len("s3a://") :] if path.startswith("s3a://") else path
    fs, local = pafs.FileSystem.from_uri(uri)
    return fs, local, path[: len(path) - len(local)] if path.endswith(local) else ""


@contextmanager
def open_source(path: str) -> Iterator[BinaryIO]:
    """Open a file, or a member of an archive, for reading and seeking."""
    outer, _, member = path.partition(MEMBER_MARK)
    fs, local, _ = file_system(outer)
    with fs.open_input_file(local) as source:
        if not member:
            yield source
            return
        with zipfile.ZipFile(source) as archive, archive.open(member) as inside:
            yield inside


def expand_braces(pattern: str) -> list[str]:
    """``a{b,c}`` as ``ab`` and ``ac``; nested braces allowed."""
    inner = re.search(r"\{([^{}]*)\}", pattern)
    if not inner:
        return [pattern]
    head, tail = pattern[: inner.start()], pattern[inner.end() :]
    return list(itertools.chain.from_iterable(expand_braces(head + choice + tail) for choice in inner[1].split(",")))


def _entry(info: pafs.FileInfo, scheme: str) -> tuple:
    kind = {pafs.FileType.File: "file", pafs.FileType.Directory: "dir"}.get(info.type, "missing")
    return scheme + info.path, kind, info.size, info.mtime


def _children(folder: str, deep: bool = False) -> list[tuple]:
    """Visible entries of a folder; unreadable folders give none."""
    fs, local, scheme = file_system(folder)
    try:
        found = [_entry(i, scheme) for i in fs.get_file_info(pafs.FileSelector(local or ".", recursive=False))]
    except (OSError, PermissionError):
        return []
    shown = [e for e in found if not os.path.basename(e[0]).startswith(".")]
    if not deep:
        return shown
    files = [e for e in shown if e[1] == "file"]
    for e in shown:
        if e[1] == "dir":
            files.extend(_children(e[0], deep=True))
    return files


def _existing(path: str) -> list[tuple]:
    fs, local, scheme = file_system(path)
    info = fs.get_file_info(local)
    return [] if info.type == pafs.FileType.NotFound else [_entry(info, scheme)]


def _glob(pattern: str) -> list[tuple]:
    """Entries matching one brace-free pattern, level by level; wildcards skip dot names."""
    pattern = os.path.expanduser(pattern)
    if not _WILD.search(pattern):
        return _existing(pattern)
    parts = pattern.split("/")
    fixed = next(i for i, part in enumerate(parts) if _WILD.search(part))
    found = [("/".join(parts[:fixed]) or ("/" if pattern.startswith("/") else ""), "dir", None, None)]
    for part in parts[fixed:]:
        folders = [e[0] for e in found if e[1] == "dir"]
        if _WILD.search(part):
            found = [e for f in folders for e in _children(f) if fnmatch.fnmatchcase(os.path.basename(e[0]), part)]
        else:
            found = [e for f in folders for e in _existing(f"{f}/{part}")]
    return found


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Patterns to entries; a pattern that matches nothing stays as a literal, missing path."""
    for batch in batches:
        rows = []
        for line, part, expression in zip(batch["line_no"], batch["part_no"], batch["expression"]):
            try:
                hits = [e for pattern in expand_braces(expression) for e in _glob(pattern)]
            except UNREADABLE:  # such as a scheme that no file system serves
                hits = []
            if hits:
                rows.extend((line, part, path, path, kind, size, seen) for path, kind, size, seen in hits)
            else:
                rows.append((line, part, expression, expression, "missing", None, None))
        yield _frame(rows)


def _open_folders(deep: bool):
    """Replace folders by their content: one level, or all of it."""

    def content(path: str, kind: str, size, seen) -> list[tuple]:
        return _children(path, deep)

    return _replace_rows(content, lambda entries: entries["kind"] == "dir")


def _are_archives(entries: pd.DataFrame) -> pd.Series:
    return (entries["kind"] == "file") & entries["path"].str.endswith(ARCHIVE_SUFFIX)


def _open_archives(path: str, kind: str, size, seen) -> list[tuple]:
    """Replace an archive by its members; one that cannot be read stays, and fails when decoded."""
    try:
        with open_source(path) as source, zipfile.ZipFile(source) as archive:
            return [(path + MEMBER_MARK + i.filename, kind, i.file_size, seen) for i in archive.infolist() if not i.is_dir()]
    except UNREADABLE:
        return [(path, kind, size, seen)]


def _replace_rows(content, chosen):
    """Entries that are ``chosen`` give way to their content, several at once; all others go on together, as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            opened = chosen(batch).to_numpy(bool)
            if not opened.all():
                yield batch.loc[~opened, _COLUMNS].astype({"length": "Int64"})
            rows = []
            for row in batch.loc[opened, _COLUMNS].itertuples(index=False):
                rows.extend((*row[:3], *e) for e in content(*row[3:]))
                if len(rows) >= ENTRY_ROWS:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=_COLUMNS)
    made["length"] = made["length"].astype("Int64")
    made["modified"] = pd.to_datetime(made["modified"], utc=True).dt.tz_localize(None)
    return made


def expressions(lines: DataFrame, column: str = "expression") -> DataFrame:
    """One row per part of each ``::`` expression (``lines`` has ``line_no`` and the text)."""
    parts = lines.select("line_no", F.posexplode(F.split(column, SEPARATOR)).alias("part_no", "expression"))
    return parts.withColumn("expression", readable_path("expression"))


def list_sources(lines: DataFrame, column: str = "expression") -> DataFrame:
    """Files of every expression in order: ``line_no, frame, path, length, modified, status``.

    Parts keep their order and duplicates; glob matches come in natural order; a directory
    is replaced by its recursive content, level by level in natural order, without dot names.
    """
    tasks = task_count(lines.sparkSession)
    found = expressions(lines, column).repartition(tasks, "line_no", "part_no", "expression").mapInPandas(_expand, _ENTRY)
    for deep in (*[False] * SPREAD_LEVELS, True):
        found = found.repartition(tasks, "line_no", "part_no", "path").mapInPandas(_open_folders(deep), _ENTRY)
    found = found.mapInPandas(_replace_rows(_open_archives, _are_archives), _ENTRY)
    outer = F.substring_index("path", MEMBER_MARK, 1)
    member = F.substring("path", F.length(outer) + F.lit(1 + len(MEMBER_MARK)), F.length("path"))
    in_store = F.col("root").startswith("s3")
    walk = F.when(in_store, natural_key(outer)).otherwise(tree_key(outer))
    keyed = found.select(
        "line_no",
        "part_no",
        "path",
        F.when(F.col("kind") == "missing", "missing").otherwise("ok").alias("status"),
        "length",
        "modified",
        natural_key("root").alias("_root"),
        F.col("root").alias("_root_raw"),
        walk.alias("_walk"),
        natural_key(member).alias("_member"),
    )
    # Equal rows (an expression may name a file twice) are counted and numbered, so that
    # the order is unique and does not depend on how tasks happened to run.
    counted = keyed.groupBy(*keyed.columns).agg(F.count("*").alias("_n"))
    single = counted.withColumn("_twin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    order = ["part_no", "_root", "_root_raw", "_walk", "_member", "path", "_twin"]
    numbered = number_rows(single, ["line_no"], order)
    return numbered.select("line_no", "frame", "part_no", "path", "length", "modified", "status")


def list_expression(spark: SparkSession, expression: str) -> DataFrame:
    """Files of one expression, in order."""
    line = spark.range(1).select(F.col("id").alias("line_no"), F.lit(expression).alias("expression"))
    return list_sources(line).drop("line_no")


def list_from_file(spark: SparkSession, path: str) -> DataFrame:
    """Files named by a text file with one expression per line, as one sequence."""
    text = spark.read.text(path).where(F.length("value") > 0)
    lines = text.select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("expression"))
    listed = list_sources(lines).withColumnRenamed("frame", "_local").withColumn("_all", F.lit(0))
    return number_rows(listed, ["_all"], ["line_no", "_local"]).drop("_all", "_local", "line_no", "part_no")
