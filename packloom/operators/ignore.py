"""Ignore files: reading their rules and applying them to every entry of their project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.globs import SPACES
from packloom.functions.paths import below, depth, file_name, parent_dir, prefixes
from packloom.functions.rules import column_rlike
from packloom.operators.joins import fits_broadcast, lookup_join, measured_join, spread_work
from packloom.operators.rule_index import ignore_probes, keyed_ignore_rules
from packloom.operators.saving import saved

# Where rules come from, strongest first: this order beats depth, and depth beats line order.
DOT_IGNORE, GIT_IGNORE, GIT_EXCLUDE = 3, 2, 1
_EXCLUDE_FILE = r"(?s)\A(?:(.*)/)?\.git/info/exclude\z"


def is_ignore_file(rel_path: Column) -> Column:
    return file_name(rel_path).isin(".ignore", ".gitignore") | rel_path.rlike(_EXCLUDE_FILE)


def ignore_files(entries: DataFrame) -> DataFrame:
    """``(project, base_dir, priority, content)`` of the entries that hold ignore rules."""
    path = F.col("rel_path")
    return entries.where(is_ignore_file(path) & F.col("content").isNotNull()).select(
        "project",
        F.when(path.rlike(_EXCLUDE_FILE), F.regexp_extract(path, _EXCLUDE_FILE, 1))
        .otherwise(parent_dir(path)).alias("base_dir"),
        F.when(path.rlike(_EXCLUDE_FILE), GIT_EXCLUDE)
        .when(file_name(path) == ".ignore", DOT_IGNORE).otherwise(GIT_IGNORE).alias("priority"),
        "content",
    )


def _rules_of(content: Column) -> Column:
    """Array of ``struct(line, raw, negated, dir_only, glob)``, blank lines and comments left out."""
    rest = lambda text, start: F.substring(text, start, 2**31 - 1)
    lines = F.split(F.regexp_replace(content, r"\A\x{FEFF}", ""), "\r?\n")
    # One transform per step, so that each step refers to the one before by name.
    rules = F.transform(lines, lambda line, i: F.struct(
        (i + 1).alias("line"),
        F.when(line.endswith("\\ "), line).otherwise(F.regexp_replace(line, rf"[{SPACES}]+\z", "")).alias("raw")))
    rules = F.filter(rules, lambda r: (r["raw"] != "") & ~r["raw"].startswith("#"))
    rules = F.transform(rules, lambda r: F.struct(
        r["line"].alias("line"), r["raw"].alias("raw"),
        r["raw"].startswith("!").alias("negated"),
        (~r["raw"].rlike(r"\A\\[!#]") & r["raw"].rlike(r"\A!?/")).alias("anchored"),
        r["raw"].endswith("/").alias("dir_only"),
        F.when(r["raw"].rlike(r"\A(?:!|\\[!#])"), rest(r["raw"], 2)).otherwise(r["raw"]).alias("body")))
    rules = F.transform(rules, lambda r: F.struct(
        r["line"].alias("line"), r["raw"].alias("raw"), r["negated"].alias("negated"),
        r["anchored"].alias("anchored"), r["dir_only"].alias("dir_only"),
        F.regexp_replace(F.when(r["anchored"], rest(r["body"], 2)).otherwise(r["body"]), r"\\?/\z", "").alias("body")))
    # A name without a slash floats: it is meant at any depth.
    return F.transform(rules, lambda r: F.struct(
        r["line"].alias("line"), r["raw"].alias("raw"), r["negated"].alias("negated"), r["dir_only"].alias("dir_only"),
        F.when(~r["anchored"] & ~F.contains(r["body"], F.lit("/")) & (r["body"] != "**"),
               F.concat(F.lit("**/"), r["body"]))
        .when(r["body"].endswith("/**"), F.concat(r["body"], F.lit("/*")))
        .otherwise(r["body"]).alias("glob")))


def ignore_rules(files: DataFrame) -> DataFrame:
    """One row per rule: ``project, base_dir, priority, line, raw, negated, dir_only, glob``."""
    return files.select("project", "base_dir", "priority", F.inline(_rules_of(F.col("content"))))


def keyed_rules(files: DataFrame) -> DataFrame:
    """The rules of the files as rows with keys, see ``rule_index.keyed_ignore_rules``."""
    return keyed_ignore_rules(files.select("project", "base_dir", "priority", _rules_of(F.col("content")).alias("r")))


def inner_repositories(entries: DataFrame) -> DataFrame:
    """Directories below the root that hold a ``.git``: git rules from above do not reach into them."""
    found = F.regexp_extract("rel_path", r"(?s)\A(.*)/\.git(?:/.*)?\z", 1)
    return entries.select("project", found.alias("base_dir")).where("base_dir <> ''").distinct()


# A rule's place as one number that sorts by depth of its file, then run; its sign in the last bit.
_DEPTH_BITS, _RUN_BITS = 33, 1


def ignored_entries(listed: DataFrame, files: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """``(project, rel_path)`` of every entry that the ignore rules remove.

    ``listed`` has ``project, rel_path, is_dir`` of files and of directories (see
    ``tree.with_directories``); ``repositories`` are the entries to find inner repositories in, by
    default the same.  An entry is ignored when it or one of its ancestors is, since nothing
    below an ignored directory is looked at.  Every directory is judged once, not once per file.
    """
    borders = inner_repositories(listed if repositories is None else repositories).select(
        "project", "base_dir", F.lit(0).alias("priority"), F.lit(0).alias("run"), F.lit(False).alias("negated"),
        F.lit("rest").alias("kind"), F.lit("").alias("key"), F.lit(True).alias("always"), F.lit(False).alias("always_dir"),
        F.lit(None).cast("string").alias("regex"))
    if not hasattr(files, "measured"):
        files = saved(files)  # rules are read several times, the texts they stand in only here
    with_rules = files.select("project").distinct()
    entries = measured_join(
        listed.select("project", "rel_path", "is_dir"), with_rules, ["project"], spread_on=["rel_path"], how="left_semi", part_of=files)
    # A few files may hold many rules: they are taken apart side by side.
    rules = saved(keyed_rules(spread_work(files, "project", "base_dir", "priority")).unionByName(borders))
    # Which rule files reach a directory is found once per directory; its entries ask only those.
    holders = entries.groupBy("project", parent_dir(F.col("rel_path")).alias("parent")).agg(F.count("*").alias("n_children"))
    reached = holders.select("project", "parent", "n_children", F.explode(
        F.when(F.col("parent") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), prefixes(F.col("parent"))))).alias("base_dir"))
    bases = measured_join(reached, rules.select("project", "base_dir").distinct(), ["project", "base_dir"], spread_on=["parent"], part_of=rules)
    facts = saved(bases.groupBy("project", "parent").agg(F.first("n_children").alias("n_children"), F.collect_list("base_dir").alias("bases")))
    asking = entries.select("project", "rel_path", "is_dir", parent_dir(F.col("rel_path")).alias("parent"))
    steps = lookup_join(asking, facts, ["project", "parent"], weight="n_children", spread_on=["rel_path"]).select(
        "project", "rel_path", "is_dir", F.explode("bases").alias("base_dir"))
    inside = below(F.col("rel_path"), F.col("base_dir"))
    probes = steps.select("project", "rel_path", "is_dir", "base_dir", F.explode(ignore_probes(F.col("rel_path"), inside)).alias("p")).select(
        "project", "rel_path", "is_dir", "base_dir", "p.kind", "p.key").where("key is not null")
    subject = F.concat(F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")), inside)
    hits = measured_join(probes, rules, ["project", "base_dir", "kind", "key"], spread_on=["rel_path"]).where(
        F.col("always") | (F.col("always_dir") & F.col("is_dir")) | F.coalesce(column_rlike(subject, F.col("regex")), F.lit(False)))

    place = (
        F.shiftleft(depth(F.col("base_dir")).cast("bigint"), _DEPTH_BITS)
        + F.shiftleft(F.col("run").cast("bigint"), _RUN_BITS) + F.col("negated").cast("bigint"))
    strongest = lambda source: F.max(F.when(F.col("priority") == source, place))
    verdicts = hits.groupBy("project", "rel_path").agg(
        F.max("is_dir").alias("is_dir"),
        strongest(DOT_IGNORE).alias("dot"), strongest(GIT_IGNORE).alias("git"),
        strongest(GIT_EXCLUDE).alias("exclude"), F.coalesce(strongest(0), F.lit(0)).alias("border"))
    reaches = lambda rule: F.when(
        F.shiftright(rule, _DEPTH_BITS) >= F.shiftright("border", _DEPTH_BITS), F.col(rule))
    winner = F.coalesce(F.col("dot"), reaches("git"), reaches("exclude"))
    removed = saved(verdicts.where(winner % 2 == 0).select("project", "rel_path", "is_dir"))

    # Pruning spreads over directories alone; a file then asks its own directory.
    directories = entries.where("is_dir").select("project", "rel_path")
    tops = removed.where("is_dir").select("project", F.col("rel_path").alias("above"))
    above = directories.withColumn("above", F.explode(prefixes(F.col("rel_path"), with_self=False)))
    inside = above.join(F.broadcast(tops) if fits_broadcast(removed) else tops, ["project", "above"], "left_semi").select("project", "rel_path")
    pruned = saved(tops.select("project", F.col("above").alias("parent")).union(inside.select("project", "rel_path")).distinct())
    files = entries.where("not is_dir").select("project", "rel_path", parent_dir(F.col("rel_path")).alias("parent"))
    if fits_broadcast(pruned):
        below_pruned = files.join(F.broadcast(pruned), ["project", "parent"], "left_semi")
    else:
        weights = files.groupBy("project", "parent").agg(F.count("*").alias("n_children"))
        facts = saved(pruned.join(weights, ["project", "parent"]).withColumn("pruned", F.lit(True)))
        below_pruned = lookup_join(files, facts, ["project", "parent"], weight="n_children", spread_on=["rel_path"]).where("pruned")
    return (
        removed.select("project", "rel_path").union(pruned.select("project", "parent"))
        .union(below_pruned.select("project", "rel_path")).distinct())
