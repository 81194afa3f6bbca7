"""Packs: the tree's lines and the framed files of each project, as ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.fixed_values import BLOCK_CLOSING
from packloom.functions.content import estimated_tokens, frame, opening
from packloom.functions.paths import path_order
from packloom.operators.decide import INCLUDED
from packloom.operators.explain import skip_reason
from packloom.operators.tree import tree_lines, tree_text

TREE, BLOCKS = 0, 1


def included(side: str) -> Column:
    return F.col(f"{side}_code").isin(*INCLUDED)


def ordered(rows: DataFrame) -> DataFrame:
    """Component-wise path order within each project."""
    return rows.orderBy("project", path_order(F.col("rel_path")))


def blocks(survivors: DataFrame) -> DataFrame:
    """One framed block per included file."""
    return survivors.select("project", "rel_path", frame(F.col("rel_path"), F.col("content")).alias("value"))


def trees(outline: DataFrame) -> DataFrame:
    """The tree's rows of every project whose tree is not switched off.

    ``outline`` has ``project, rel_path, is_dir, tree_code`` of every entry.  It is used many
    times over, so hand in a saved table.  A project in which every path is excluded still gets
    its heading line.
    """
    shown = outline.where(included("tree")).select("project", "rel_path", "is_dir")
    projects = outline.where(F.col("tree_code") != "tree_disabled").select("project").distinct()
    return tree_text(tree_lines(shown), projects)


def pack(outline: DataFrame, survivors: DataFrame) -> DataFrame:
    """``project, section, path_order, value``: rows of the packs, tree first, then the blocks.

    A pack is its rows' values in (section, path_order).  ``outline`` has the tree decisions,
    ``survivors`` are the included files with their content.
    """
    tree_rows = trees(outline).select(
        "project", F.lit(TREE).alias("section"), "path_order", F.concat("line", F.lit("\n")).alias("value"))
    block_rows = blocks(survivors).select(
        "project", F.lit(BLOCKS).alias("section"), path_order(F.col("rel_path")).alias("path_order"), "value")
    return tree_rows.unionByName(block_rows)


def block_tokens(rel_path: Column, tokens_of_content: Column, tokens=estimated_tokens) -> Column:
    """Tokens of a block: its opening, content and closing, each counted by itself."""
    return tokens(opening(rel_path)) + tokens_of_content + tokens(F.lit(BLOCK_CLOSING))


def preview(decided: DataFrame, max_kib: Column) -> DataFrame:
    """The dry run: a status line for every file that reading decides about, nothing written."""
    path, code = F.col("rel_path"), F.col("content_code")
    why = skip_reason(code, max_kib, F.col("length"), F.col("read_error"), F.col("is_dir"))
    lossy = F.when(code == "included_lossy", ", lossy UTF-8").otherwise("")
    line = F.when(
        included("content"), F.format_string("[EXPECT] %s (%d content tokens%s)", path, F.col("content_tokens"), lossy)
    ).otherwise(F.format_string("[SKIP] %s (%s)", path, why))
    return decided.where(included("content") | why.isNotNull()).select("project", "rel_path", line.alias("status_line"))
