"""Subtree totals of directory trees by interval labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.paths import parent_dir, path_order, prefixes
from packloom.operators.order import running_sums

_CLOSING, _OPENING = 0, 1


def _place(rel_path: Column) -> Column:
    """Sorts nodes in preorder: the root, then every path behind its directory."""
    return F.when(rel_path == "", F.lit("")).otherwise(F.concat(F.lit("\0"), path_order(rel_path)))


def directories_of(entries: DataFrame) -> DataFrame:
    """``project, rel_path`` of every directory that entries are in or are, the root (``''``) included.

    Files are reduced to their distinct directories first, so only directories meet their ancestors.
    """
    holding = entries.select("project", F.when(F.col("is_dir"), F.col("rel_path")).otherwise(parent_dir(F.col("rel_path"))).alias("rel_path")).distinct()
    above = holding.where("rel_path <> ''").select("project", F.explode(prefixes(F.col("rel_path"))).alias("rel_path"))
    return above.unionByName(entries.select("project", F.lit("").alias("rel_path"))).distinct()


def directory_totals(entries: DataFrame, weights: list[str]) -> DataFrame:
    """``project, directory, first, last, files`` and the sums of ``weights`` below every directory.

    ``entries`` have ``project, rel_path, is_dir``; weights are whole numbers, those of directories
    and nulls count nothing.  ``first`` is the directory's number in preorder (the root is 0) and
    ``last`` that of its last descendant, so a node lies below it if its number is in between.

    Every directory stands twice in preorder, where its subtree begins and where it ends.  What is
    below it is the difference of two running sums, however deep the tree; no file is copied to
    its ancestors, and a project of any size spreads over all tasks.
    """
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    path = F.col("rel_path")
    files = entries.where("not is_dir").select(
        "project", "rel_path", _place(path).alias("_place"), F.lit(_OPENING).alias("_kind"), F.lit(False).alias("_dir"),
        one.alias("_node"), one.alias("_file"), *[F.coalesce(F.col(w).cast("bigint"), zero).alias(w) for w in weights])
    none = [zero.alias("_file"), *[zero.alias(w) for w in weights]]
    # An ending sorts behind all that begins with the directory's place and a NUL, and before whatever else follows.
    marks = F.explode(F.array(
        F.struct(_place(path).alias("_place"), F.lit(_OPENING).alias("_kind"), one.alias("_node")),
        F.struct(F.concat(_place(path), F.lit("\x01")).alias("_place"), F.lit(_CLOSING).alias("_kind"), zero.alias("_node"))))
    directories = directories_of(entries).select("project", "rel_path", marks.alias("m")).select(
        "project", "rel_path", "m._place", "m._kind", F.lit(True).alias("_dir"), "m._node", *none)
    sums = {f"_before_{c}": c for c in ("_node", "_file", *weights)}
    placed = running_sums(files.unionByName(directories), "project", ["_place", "_kind", "rel_path"], sums).where("_dir")
    at = lambda kind, c: F.max(F.when(F.col("_kind") == kind, F.col(f"_before_{c}")))
    below = lambda c: at(_CLOSING, c) - at(_OPENING, c)
    return placed.groupBy("project", F.col("rel_path").alias("directory")).agg(
        at(_OPENING, "_node").alias("first"), (at(_CLOSING, "_node") - 1).alias("last"), below("_file").alias("files"),
        *[below(w).alias(w) for w in weights])
