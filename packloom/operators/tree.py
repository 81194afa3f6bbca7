"""Directory trees of many projects, one row per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.fixed_values import TREE_LAST, TREE_MIDDLE, TREE_UNDER_LAST, TREE_UNDER_MIDDLE
from packloom.functions.paths import file_name, parent_dir, path_order, prefixes
from packloom.operators.joins import lookup_join, unique_join
from packloom.operators.saving import saved


def node_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("/"), name))


def missing_directories(entries: DataFrame) -> DataFrame:
    """``(project, rel_path)`` of the ancestors that paths imply and no entry stands for.

    Only directories are shuffled: entries meet the implied directories by a broadcast if those fit.
    """
    implied = saved(
        entries.select("project", F.explode(prefixes(F.col("rel_path"), with_self=False)).alias("rel_path")).distinct())
    listed = unique_join(entries.select("project", "rel_path"), implied, ["project", "rel_path"], "left_semi")
    return saved(implied.join(listed, ["project", "rel_path"], "left_anti"))


def with_directories(entries: DataFrame) -> DataFrame:
    """Add the directories that the paths imply, as a listing of the files would show them."""
    added = missing_directories(entries).withColumns({"is_dir": F.lit(True), "is_file": F.lit(False)})
    if "is_file" not in entries.columns:
        added = added.drop("is_file")
    return entries.unionByName(added, allowMissingColumns=True)


def expand_nodes(entries: DataFrame) -> DataFrame:
    """``(project, parent, name, is_dir)``: each entry and every ancestor it implies, once.

    An implied ancestor is a directory; an entry of its own decides for itself.
    """
    path = F.col("rel_path")
    return with_directories(entries.select("project", "rel_path", "is_dir")).select(
        "project", parent_dir(path).alias("parent"), file_name(path).alias("name"), "is_dir")


def directory_facts(nodes: DataFrame) -> DataFrame:
    """Per directory: name of its last child and number of children (combined before the shuffle)."""
    return nodes.groupBy("project", "parent").agg(F.max("name").alias("last_name"), F.count("*").alias("n_children"))


def mark_last(nodes: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """Add ``is_last``: the node is the last of its siblings by byte order.

    Joining on the full node key instead of the parent keeps a huge directory from landing in
    one partition.
    """
    directories = directory_facts(nodes) if directories is None else directories
    lasts = directories.select("project", "parent", F.col("last_name").alias("name"), F.lit(True).alias("is_last"))
    return nodes.join(lasts, ["project", "parent", "name"], "left").fillna(False, "is_last")


def directory_indents(directories: DataFrame) -> DataFrame:
    """Add ``indent`` to directory facts: the text before the connector of the directory's children."""
    path = F.col("parent")
    own = directories.where("parent <> ''").select(
        "project", path.alias("above"), parent_dir(path).alias("parent"), file_name(path).alias("name"))
    bars = mark_last(own, directories).select(
        "project", "above",
        F.when(F.col("is_last"), F.lit(TREE_UNDER_LAST)).otherwise(F.lit(TREE_UNDER_MIDDLE)).alias("bar"))
    chains = directories.where("parent <> ''").select("project", "parent", F.posexplode(prefixes(path)).alias("level", "above"))
    heirs = chains.groupBy("project", "above").agg(F.count("*").alias("n_below"))
    facts = saved(heirs.join(bars, ["project", "above"]))
    steps = lookup_join(chains, facts, ["project", "above"], weight="n_below", spread_on=["parent"])
    indents = steps.groupBy("project", "parent").agg(
        # one element per ancestor of this one directory
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "bar"))), lambda s: s["bar"]), "")
        .alias("indent"))
    return directories.join(indents, ["project", "parent"], "left").fillna("", "indent")


def indented(nodes: DataFrame) -> DataFrame:
    """Add ``is_last`` and ``indent`` to nodes, both from their directory in one join."""
    facts = saved(directory_indents(saved(directory_facts(nodes))))
    found = lookup_join(nodes, facts, ["project", "parent"], weight="n_children", spread_on=["name"])
    return found.withColumn("is_last", F.col("name") == F.col("last_name")).drop("last_name")


def tree_lines(entries: DataFrame) -> DataFrame:
    """``(project, rel_path, line)`` for every node of the tree that the entries make."""
    name = F.concat("name", F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")))
    connector = F.when(F.col("is_last"), F.lit(TREE_LAST)).otherwise(F.lit(TREE_MIDDLE))
    return indented(expand_nodes(entries)).select(
        "project",
        node_path(F.col("parent"), F.col("name")).alias("rel_path"),
        F.concat("indent", connector, name).alias("line"),
    )


def tree_text(lines: DataFrame, projects: DataFrame) -> DataFrame:
    """``(project, path_order, line)``: the lines headed by ``project/``.

    Joined by newlines in ``path_order`` they are the tree's text.  They stay rows because the
    tree of a large project must not have to fit into one value.
    """
    heads = projects.select(
        "project", F.lit("").alias("path_order"),
        F.concat(F.coalesce(F.nullif("project", F.lit("")), F.lit(".")), F.lit("/")).alias("line"))
    return heads.unionByName(lines.select("project", path_order(F.col("rel_path")).alias("path_order"), "line"))
