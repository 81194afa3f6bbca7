"""Listing directory trees: metadata of every file, directory and link, no file opened.

Unlike ``binaryFile`` the listing keeps hidden, empty and ``_``-prefixed files, has rows for
directories, and does not follow links.  Directories must be mounted on every executor.
"""

from __future__ import annotations

import itertools
import os
import stat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.operators.joins import spread_work, unique_join
from packloom.operators.saving import measured, saved

ENTRY = (
    "project string, rel_path string, is_dir boolean, is_file boolean, length bigint, link_target string, "
    "root string, read_error string, location binary")
ARROW_ENTRY = pa.schema([
    ("project", pa.string()), ("rel_path", pa.string()), ("is_dir", pa.bool_()), ("is_file", pa.bool_()),
    ("length", pa.int64()), ("link_target", pa.string()), ("root", pa.string()), ("read_error", pa.string()),
    ("location", pa.binary())])
BATCH_ROWS = 10_000


def os_error_text(error: OSError) -> str:
    return f"{error.strerror} (os error {error.errno})"


def _shown(path: bytes) -> str:
    """Path as valid text; undecodable bytes become U+FFFD."""
    return path.decode("utf-8", "replace")


def _entry(project: str, root: str, entry: os.DirEntry) -> dict:
    is_dir, error, target, length, is_file = entry.is_dir(follow_symlinks=False), None, None, None, False
    if entry.is_symlink():
        try:
            target = _shown(os.path.realpath(entry.path, strict=True))
        except OSError:
            target = ""
    try:
        facts = os.stat(entry.path)
        is_file, length = stat.S_ISREG(facts.st_mode), None if is_dir else facts.st_size
    except OSError as failure:
        error = f"metadata: {os_error_text(failure)}"
    if is_dir:
        try:
            os.scandir(entry.path).close()
        except OSError as failure:
            error = f"list: {os_error_text(failure)}"
    rel_path = _shown(os.path.relpath(entry.path, os.fsencode(root)))
    return dict(project=project, rel_path=rel_path, is_dir=is_dir, is_file=is_file, length=length,
                link_target=target, root=root, read_error=error, location=entry.path)


def children_of(directory: dict) -> Iterator[dict]:
    """Entries of one directory; if listing it fails at any point, a last row without location says so."""
    project, root = directory["project"], directory["root"]
    try:
        with os.scandir(directory["location"]) as children:
            for child in children:
                yield _entry(project, root, child)
    except OSError as failure:
        rel_path = _shown(os.path.relpath(directory["location"], os.fsencode(root)))
        yield dict(project=project, rel_path="" if rel_path == "." else rel_path, is_dir=True, is_file=False, length=None, link_target=None,
                   root=root, read_error=f"list: {os_error_text(failure)}", location=None)


def _list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The direct children of each directory."""
    for batch in batches:
        for directory in batch.to_pylist():
            entries = children_of(directory)
            while rows := list(itertools.islice(entries, BATCH_ROWS)):
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW_ENTRY)


def read_entries(spark: SparkSession, roots: list[str] | DataFrame) -> DataFrame:
    """Entries of the given directories, one project each, named after the directory.

    ``roots`` may also be a table (project, root) of resolved paths.  The trees are listed level
    by level: all directories of a level are spread over the cluster, so neither a large project
    nor a large subtree is listed by one task, and the number of jobs is the depth of the trees.
    """
    if not isinstance(roots, DataFrame):
        resolved = [os.path.realpath(root) for root in roots]
        for root, given in zip(resolved, roots):
            if not os.path.isdir(root):
                raise NotADirectoryError(f"Scan path must be a directory: {given}")
        roots = spark.createDataFrame([(os.path.basename(r) or ".", r) for r in resolved], "project string, root string")
    level = roots.select("project", "root", F.encode("root", "UTF-8").alias("location"))
    levels = []
    while not levels or measured(levels[-1])["rows"]:
        levels.append(saved(spread_work(level, "location").mapInArrow(_list_directories, ENTRY)))
        level = levels[-1].where("is_dir and read_error is null and location is not null").select("project", "root", "location")
    return with_failures(reduce(DataFrame.unionByName, levels))


def with_failures(listed: DataFrame) -> DataFrame:
    """Put listing failures (rows without location) on their directories; a root that failed keeps a row of its own."""
    failures = listed.where("location is null")
    if failures.isEmpty():
        return listed
    found = saved(failures.groupBy("project", "rel_path").agg(F.min("read_error").alias("_failure")))
    entries = unique_join(listed.where("location is not null"), found, ["project", "rel_path"], "left").withColumn(
        "read_error", F.coalesce("read_error", "_failure")).drop("_failure")
    return entries.unionByName(failures.where("rel_path = ''").dropDuplicates(["project"]))
