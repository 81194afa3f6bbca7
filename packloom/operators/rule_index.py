"""Rules as rows that paths look up: an equi-join finds the few rules that may match a path.

A glob demands something of a path that can be compared for equality: its whole text, the name at
its end, the name's ending or beginning, the first component, a directory it lies in.  This is the
rule's key; what the glob demands beyond it is a regex that only paths with the key are held
against.  A glob that demands nothing of the kind has the empty key of kind ``rest``.

kind     key                                        of the path ``src/ab/x.tar.gz``
-------  -----------------------------------------  --------------------------------
path     the whole path                             ``src/ab/x.tar.gz``
name     its last component                         ``x.tar.gz``
ext      what follows the last dot of the name      ``gz``
stem     what precedes the first dot of the name    ``x``
top      the first component                        ``src``
below    a directory it lies in                     ``src``, ``src/ab``
inside   the name of a directory it lies in         ``src``, ``ab``
rest     nothing                                    (empty)
end      any ending of the path                     ``z``, ``gz``, ``.gz``, ...
part     any beginning of a component               ``s``, ``sr``, ..., ``ab``, ``x.t``, ...
begin    any beginning of the path                  ``s``, ``sr``, ``src``, ``src/``, ...

The last three are for pattern lists alone.  A pattern that no key settles has all the keys it
demands to choose from, and is found by the one that the fewest patterns of its project demand: many
patterns that share an ending or a first directory would meet every path that has it.  Paths look up
beginnings and endings of the lengths that the index holds.  Only patterns that hold no plain text
there, or classes and choices, are ``rest`` and meet all paths of their project.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packloom.functions.globs import compile_patterns, glob_body, split_patterns, whole
from packloom.functions.paths import file_name, parent_dir, prefixes
from packloom.functions.rules import column_rlike
from packloom.operators.joins import lookup_join, measured_join
from packloom.operators.saving import saved

_SPECIAL, _NESTED = set("*?[]{}\\"), set("[]{}\\")
_WILD = re.compile(r"[*?]+")


def _literal(text: str) -> bool:
    return not _SPECIAL & set(text)


def glob_key(glob: str, crosses_slash: bool = True) -> tuple[str, str, bool]:
    """``kind, key`` of a glob, and whether a path with the key matches it for sure."""
    if _NESTED & set(glob):
        return "rest", "", False
    if _literal(glob) and crosses_slash:
        return "path", glob, True
    before, slash, last = glob.rpartition("/")
    ending = last.rpartition(".")[2]
    if last == "**" and slash and crosses_slash:
        if _literal(before):
            return "below", before, True
        if before.startswith("**/") and _literal(before[3:]) and "/" not in before[3:]:
            return "inside", before[3:], True
    if last and _literal(last) and (slash or not crosses_slash):
        return "name", last, before == "**"
    if "." in last and ending and _literal(ending) and "*" not in ending:
        alone = last == f"*.{ending}" and (before == "**" if slash else crosses_slash)
        return "ext", ending, alone
    stem = last.partition(".")[0]
    if not crosses_slash and "." in last and _literal(stem):
        return "stem", stem, False
    top = glob.partition("/")[0]
    if slash and top and _literal(top):
        return "top", top, False
    return "rest", "", False


def glob_keys(glob: str) -> tuple[list[tuple[str, str]], bool]:
    """The ``kind, key`` pairs a pattern's glob demands, the better ones first, and whether the only one decides."""
    kind, key, sure = glob_key(glob)
    if sure or _NESTED & set(glob):
        return [(kind, key)], sure
    runs = _WILD.split(glob)
    # "**/x" also matches "x", so that a slash after two stars may stand for none.
    end = runs[-1][1:] if runs[-1].startswith("/") and glob.removesuffix(runs[-1]).endswith("**") else runs[-1]
    parts = sorted({part for run in runs for part in run.split("/")[1:] if part}, key=lambda p: (-len(p), p))
    found = [(kind, key)] if kind == "name" else []
    found += [("end", end)] if end else []
    found += [("part", part) for part in parts]
    found += [("begin", runs[0])] if runs[0] else []
    found += [(kind, key)] if kind in ("ext", "top") else []
    return found or [("rest", "")], False


def name_ending(name: Column) -> Column:
    """What follows the last dot of a name, null without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))


# ---- ignore files

_KEYED = T.ArrayType(
    T.StructType().add("run", "integer").add("negated", "boolean").add("kind", "string").add("key", "string")
    .add("always", "boolean").add("always_dir", "boolean").add("regex", "string"))


@F.pandas_udf(_KEYED)
def _keyed_rules(globs: pd.Series, negated: pd.Series, dir_only: pd.Series) -> pd.Series:
    """The rules of each file by key; rules of one key and one run of equal signs are one row.

    Only the last matching sign counts, so the rules of a run need no order among themselves.  The
    text to match is the path below the file's directory, with a leading ``/`` for directories.
    A malformed glob is skipped, like a comment.
    """
    result = []
    for file_globs, file_negated, file_dir_only in zip(globs, negated, dir_only):
        run, last, found = -1, None, {}
        for glob, sign, only_dirs in zip(file_globs, file_negated, file_dir_only):
            try:
                body = glob_body(glob, crosses_slash=False)
            except ValueError:
                continue
            if sign != last:
                run, last = run + 1, sign
            kind, key, sure = glob_key(glob, crosses_slash=False)
            both, dirs, flags = found.setdefault((run, bool(sign), kind, key), ([], [], [False, False]))
            if sure:
                flags[1 if only_dirs else 0] = True
            else:
                (dirs if only_dirs else both).append(body)
        result.append([
            {"run": run, "negated": sign, "kind": kind, "key": key, "always": flags[0], "always_dir": flags[1],
             "regex": "(?s)\\A(?:" + "|".join(
                 head + "(?:" + "|".join(bodies) + ")" for head, bodies in (("/?+", both), ("/", dirs)) if bodies) + ")\\z"
             if both or dirs else None}
            for (run, sign, kind, key), (both, dirs, flags) in found.items()])
    return pd.Series(result)


def keyed_ignore_rules(parsed: DataFrame) -> DataFrame:
    """``project, base_dir, priority, run, negated, kind, key, always, always_dir, regex`` of parsed ignore files.

    ``parsed`` has the rules of a file as the array ``r``.
    """
    keyed = _keyed_rules(F.col("r.glob"), F.col("r.negated"), F.col("r.dir_only"))
    return parsed.select("project", "base_dir", "priority", F.inline(keyed))


def ignore_probes(rel_path: Column, below: Column) -> Column:
    """The keys under which rules may match an entry, some of them null; ``below`` is its path as its rules see it."""
    name = file_name(rel_path)
    probe = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    return F.array(
        probe("name", name), probe("ext", name_ending(name)),
        probe("stem", F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", 1))),
        probe("top", F.when(F.contains(below, F.lit("/")), F.substring_index(below, "/", 1))), probe("rest", F.lit("")))


# ---- pattern lists as rows

_PATTERN = T.ArrayType(
    T.StructType().add("raw", "string").add("keys", T.ArrayType(T.StructType().add("kind", "string").add("key", "string")))
    .add("regex", "string").add("error", "string"))


@F.pandas_udf(_PATTERN)
def _pattern_keys(raw: pd.Series) -> pd.Series:
    """Keys to choose from of each pattern, a row per glob it stands for, or its error; blank patterns have none."""
    result = []
    for text in raw:
        rows = []
        try:
            compile_patterns(text)
            for pattern, globs in split_patterns(text):
                for glob in globs:
                    keys, sure = glob_keys(glob)
                    rows.append({"raw": pattern, "keys": [{"kind": kind, "key": key} for kind, key in keys],
                                 "regex": None if sure else whole(glob_body(glob)), "error": None})
        except ValueError as error:
            rows = [{"raw": text, "keys": [], "regex": None, "error": str(error)}]
        result.append(rows)
    return pd.Series(result)


def pattern_index(patterns: DataFrame) -> DataFrame:
    """``project, raw, kind, key, regex, error, ord`` of patterns ``project, ord, raw``, saved.

    A bad pattern has an ``error`` and no key, and matches nothing.  Equal rules of a project are
    one, that of the least ``ord``.  Of the keys a rule may have, it gets the one that the fewest
    rules of its project may have.
    """
    rows = patterns.select("project", F.col("ord").cast("bigint").alias("ord"), F.inline(_pattern_keys(F.col("raw"))))
    rules = saved(rows.groupBy("project", "raw", "keys", "regex", "error").agg(F.min("ord").alias("ord")).withColumn("id", F.monotonically_increasing_id()))
    choices = rules.select("id", "project", "raw", "regex", "error", "ord", F.posexplode_outer("keys").alias("place", "choice")).select(
        "id", "project", "raw", "regex", "error", "ord", "place", "choice.*")
    common = saved(choices.where("kind is not null").groupBy("project", "kind", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("rules", F.col("n")))
    weighed = lookup_join(choices, common, ["project", "kind", "key"], weight="n", spread_on=["id"])
    same = [F.first(c).alias(c) for c in ("project", "raw", "regex", "error", "ord")]
    return saved(weighed.groupBy("id").agg(*same, F.min(F.struct("rules", "place", "kind", "key")).alias("best")).select(
        "project", "raw", "best.kind", "best.key", "regex", "error", "ord"))


def _path_probes(path: Column, index: DataFrame) -> Column:
    """The keys under which rules of the index may match a path, some of them null; below directories excepted."""
    name = file_name(path)
    probe = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    probes = F.array(
        probe("path", path), probe("name", name), probe("ext", name_ending(name)),
        probe("top", F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1))), probe("rest", F.lit("")))
    lengths: dict[str, list[int]] = {}
    for row in index.where("kind in ('begin', 'end', 'part')").select("kind", F.length("key").alias("n")).distinct().collect():
        lengths.setdefault(row["kind"], []).append(row["n"])

    def some(kind: str, text: Column, first) -> Column:
        fitting = F.filter(F.array(*map(F.lit, sorted(lengths[kind]))), lambda n: n <= F.length(text))
        return F.transform(fitting, lambda n: probe(kind, F.substring(text, first(n), n)))

    if "begin" in lengths:
        probes = F.concat(probes, some("begin", path, lambda n: F.lit(1)))
    if "end" in lengths:
        probes = F.concat(probes, some("end", path, lambda n: F.length(path) - n + 1))
    if "part" in lengths:
        probes = F.concat(probes, F.array_distinct(F.flatten(F.transform(F.split(path, "/"), lambda c: some("part", c, lambda n: F.lit(1))))))
    return probes


def first_rules(entries: DataFrame, index: DataFrame) -> DataFrame:
    """``project, rel_path, ord, rule`` of every entry: the first pattern of its project that matches it, nulls if none does.

    ``entries`` have unique ``project, rel_path``.  Rules that speak of directories are matched once
    per directory; an entry then asks its directory and looks its own keys up.
    """
    path = F.col("rel_path")
    best = F.min(F.struct("ord", "raw"))
    of_directories = index.where("kind in ('below', 'inside')")
    of_paths = index.where("kind not in ('below', 'inside')")

    holders = entries.groupBy("project", parent_dir(path).alias("parent")).agg(F.count("*").alias("n"))
    above = holders.where("parent <> ''").select("project", "parent", F.explode(prefixes(F.col("parent"))).alias("above"))
    sides = above.select("project", "parent", F.explode(F.array(
        F.struct(F.lit("below").alias("kind"), F.col("above").alias("key")),
        F.struct(F.lit("inside").alias("kind"), file_name(F.col("above")).alias("key")))).alias("p")).select("project", "parent", "p.*")
    found = measured_join(sides, of_directories, ["project", "kind", "key"], spread_on=["parent"], part_of=index)
    facts = saved(holders.join(found.groupBy("project", "parent").agg(best.alias("of_dir")), ["project", "parent"]))

    asking = entries.select("project", "rel_path", parent_dir(path).alias("parent"))
    known = lookup_join(asking, facts, ["project", "parent"], weight="n", spread_on=["rel_path"])
    asked = asking.select("project", "rel_path", F.explode(_path_probes(path, of_paths)).alias("p")).select(
        "project", "rel_path", "p.*").where("key is not null")
    hits = measured_join(asked, of_paths, ["project", "kind", "key"], spread_on=["rel_path"], part_of=index).where(
        F.col("regex").isNull() | column_rlike(path, F.col("regex")))
    every = known.select("project", "rel_path", "of_dir").unionByName(
        hits.select("project", "rel_path", F.struct("ord", "raw").alias("of_dir")))
    return every.groupBy("project", "rel_path").agg(F.min("of_dir").alias("first")).select(
        "project", "rel_path", "first.ord", F.col("first.raw").alias("rule"))
