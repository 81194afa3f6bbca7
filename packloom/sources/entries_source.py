"""Directory trees as a Spark data source: ``spark.read.format("directory_entries")``.

Options: ``roots`` (a JSON list of directories, one project each, named after the directory),
``prune`` (``true``: directories that ignore files remove are listed themselves and not entered)
and ``partitions`` (subtrees to plan, by default ``spark.sql.shuffle.partitions``).

Planning lists from the roots down until there are enough subtrees, so the driver lists no more
directories than there are partitions.  A task walks its subtrees.  Filters on ``project`` and on
the beginning of ``rel_path`` are pushed down with the option ``pushdown``, which needs
``spark.sql.python.filterPushdown.enabled``: other projects and other subtrees are never listed.

Pruning decides about directories only, by the rule files on the way down to them, as
``operators.ignore`` does for all entries; what is listed is judged there.  One subtree that holds
most of a corpus is one task here, and spread level by level by ``directory.read_entries``.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from packloom.functions.globs import STRIPPED, glob_body
from packloom.sources.directory import ARROW_ENTRY, BATCH_ROWS, ENTRY, children_of

FORMAT = "directory_entries"
_DOT, _GIT, _EXCLUDE = 0, 1, 2
_FILES = {".ignore": _DOT, ".gitignore": _GIT, ".git/info/exclude": _EXCLUDE}


def parse_rules(content: str) -> list[tuple[bool, bool, str]]:
    """``negated, dir_only, regex`` of the rules of an ignore file; malformed lines are skipped."""
    rules = []
    for line in re.split("\r?\n", content.removeprefix("﻿")):
        raw = line if line.endswith("\\ ") else line.rstrip(STRIPPED)
        if not raw or raw.startswith("#"):
            continue
        literal = re.match(r"\\[!#]", raw)
        body = raw[1:] if literal or raw.startswith("!") else raw
        anchored = not literal and body.startswith("/")
        body = re.sub(r"\\?/\Z", "", body[1:] if anchored else body)
        if not anchored and "/" not in body and body != "**":
            body = f"**/{body}"
        elif body.endswith("/**"):
            body += "/*"
        try:
            rules.append((raw.startswith("!"), raw.endswith("/"), glob_body(body, crosses_slash=False)))
        except ValueError:
            continue
    return rules


@dataclass(frozen=True)
class Subtree(InputPartition):
    """A directory to list, with all below it or alone, and the rules that reach it."""

    project: str
    root: str
    location: bytes
    whole: bool = True
    rules: tuple = ()  # (kind, directory, its rules), from the root down
    border: int = 0  # components of the innermost repository's directory

    @property
    def rel_path(self) -> str:
        found = os.path.relpath(self.location, os.fsencode(self.root)).decode("utf-8", "replace")
        return "" if found == "." else found

    def ignores(self, directory: str) -> bool:
        """Do the rules remove this directory?  Stronger files first, then deeper ones, then later lines."""
        for kind in (_DOT, _GIT, _EXCLUDE):
            for of, base, rules in reversed(self.rules):
                if of != kind or (kind != _DOT and len(_parts(base)) < self.border):
                    continue
                below = directory[len(base) + 1 :] if base else directory
                for negated, _, regex in reversed(rules):
                    if re.fullmatch(regex, below, re.DOTALL):
                        return not negated
        return False


@dataclass(frozen=True)
class Subtrees(InputPartition):
    parts: tuple[Subtree, ...] = field(default=())


def _parts(path: str) -> list[str]:
    return path.split("/") if path else []


def _read_rules(location: bytes) -> Iterator[tuple[int, list]]:
    for name, kind in _FILES.items():
        try:
            with open(os.path.join(location, os.fsencode(name)), "rb") as file:
                yield kind, parse_rules(file.read().decode("utf-8", "replace"))
        except OSError:
            continue


class EntriesReader(DataSourceReader):
    def __init__(self, roots: list[str], prune: bool, partitions: int):
        self.roots, self.prune, self.partitions_wanted = roots, prune, partitions
        self.projects: set[str] | None = None
        self.prefix = ""

    def partitions(self) -> list[InputPartition]:
        open_ones, done = deque(), []
        for root in self.roots:
            project = os.path.basename(root) or "."
            if self.projects is None or project in self.projects:
                open_ones.append(Subtree(project, root, os.fsencode(root)))
        # Breadth first: a directory that is taken apart is listed alone, its directories become subtrees.
        while open_ones and len(open_ones) + len(done) < self.partitions_wanted:
            tree = open_ones.popleft()
            done.append(replace(tree, whole=False))
            open_ones += [below for _, below in self._children(tree) if below is not None]
        found = [*done, *open_ones]
        return [Subtrees(tuple(found[at :: self.partitions_wanted])) for at in range(min(len(found), self.partitions_wanted))] or [Subtrees()]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        rows = (row for tree in partition.parts for row in self._walk(tree))
        while some := list(itertools.islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_pylist(some, schema=ARROW_ENTRY)

    def _walk(self, tree: Subtree) -> Iterator[dict]:
        stack = [tree]
        while stack:
            directory = stack.pop()
            for entry, below in self._children(directory):
                yield entry
                if below is not None and tree.whole:
                    stack.append(below)

    def _children(self, tree: Subtree) -> Iterator[tuple[dict, Subtree | None]]:
        """The direct entries of a directory, and the subtree of those that are to be entered."""
        here = tree.rel_path
        if self.prune:
            found = tuple((kind, here, rules) for kind, rules in _read_rules(tree.location))
            repository = here and os.path.lexists(os.path.join(tree.location, b".git"))
            tree = replace(tree, rules=tree.rules + found, border=len(_parts(here)) if repository else tree.border)
        for entry in children_of({"project": tree.project, "root": tree.root, "location": tree.location}):
            path, below = entry["rel_path"], None
            if entry["is_dir"] and entry["location"] is not None and entry["read_error"] is None and self._wanted(path):
                if not (self.prune and tree.ignores(path)):
                    below = replace(tree, location=entry["location"], whole=True)
            yield entry, below

    def _wanted(self, directory: str) -> bool:
        """May the directory hold paths that begin as asked for?"""
        return f"{directory}/".startswith(self.prefix) or self.prefix.startswith(f"{directory}/")


class FilteredReader(EntriesReader):
    """A reader that Spark tells its filters; it only may where the session allows push-down."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute == ("project",):
                self.projects = {one.value} if self.projects is None else self.projects & {one.value}
                continue
            if isinstance(one, StringStartsWith) and one.attribute == ("rel_path",) and one.value.startswith(self.prefix):
                self.prefix = one.value
            yield one


class EntriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> EntriesReader:
        roots = [os.path.realpath(root) for root in json.loads(self.options["roots"])]
        for root in roots:
            if not os.path.isdir(root):
                raise NotADirectoryError(f"Scan path must be a directory: {root}")
        chosen = lambda name: self.options.get(name, "false").lower() == "true"
        return (FilteredReader if chosen("pushdown") else EntriesReader)(roots, chosen("prune"), int(self.options.get("partitions", "8")))


def scan_entries(spark: SparkSession, roots: list[str], prune: bool = False, partitions: int | None = None) -> DataFrame:
    """The entries of the given directories by the data source; failures of directories are on rows without location."""
    for root in roots:
        if not os.path.isdir(root):
            raise NotADirectoryError(f"Scan path must be a directory: {root}")
    spark.dataSource.register(EntriesSource)
    wanted = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format(FORMAT).options(
        roots=json.dumps(roots), prune=str(prune).lower(), partitions=str(wanted), pushdown=pushdown).load()
