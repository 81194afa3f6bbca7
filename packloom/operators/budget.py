"""Token caps: where each project's pack ends if it may hold so many tokens only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.paths import path_order
from packloom.operators.joins import measured_join
from packloom.operators.order import running_sums
from packloom.operators.render import block_tokens, included
from packloom.operators.saving import saved
from packloom.operators.stats import tree_tokens


def rooms(outline: DataFrame, max_tokens: int | DataFrame, tokens) -> DataFrame:
    """``project, room``: tokens left for the blocks of each project that has a cap, once its tree is written.

    ``max_tokens`` is one cap for all projects, or a table ``project, max_tokens`` in which a missing
    or null cap is none; of several caps of a project the least holds.
    """
    trees = tree_tokens(outline, tokens).groupBy("project").agg(F.sum("n").alias("_tree"))
    if isinstance(max_tokens, DataFrame):
        caps = max_tokens.where("max_tokens is not null").groupBy("project").agg(F.min("max_tokens").alias("_cap"))
    else:
        caps = outline.select("project").distinct().withColumn("_cap", F.lit(max_tokens))
    spent = F.coalesce("_tree", F.lit(0))
    return caps.join(trees, "project", "left").select("project", (F.col("_cap").cast("bigint") - spent).alias("room"))


def token_cap(decided: DataFrame, outline: DataFrame, max_tokens: int | DataFrame, tokens) -> DataFrame:
    """``project, rel_path, block_tokens, tokens_before, kept`` of every included file.

    Blocks are taken in pack order until the first that does not fit; it and all behind it are
    left out, also where a later one would fit.  The tree comes first and is never cut: if it fills
    the cap alone, no block is kept.  ``tokens_before`` are those of the project's earlier blocks.

    The running sum goes over range partitions, so no project has to be in one task; a project's
    room is one row, sent to all tasks or salted.
    """
    blocks = decided.where(included("content")).select(
        "project", "rel_path", path_order(F.col("rel_path")).alias("_place"),
        block_tokens(F.col("rel_path"), F.col("content_tokens"), tokens).alias("block_tokens"))
    placed = running_sums(blocks, "project", ["_place"], {"tokens_before": "block_tokens"})
    known = measured_join(placed, saved(rooms(outline, max_tokens, tokens)), ["project"], spread_on=["rel_path"], how="left")
    fits = F.col("tokens_before") + F.col("block_tokens") <= F.col("room")
    return known.select("project", "rel_path", "block_tokens", "tokens_before", F.coalesce(fits, F.lit(True)).alias("kept"))


def cuts(capped: DataFrame) -> DataFrame:
    """``project, cut_at``: place of the first block left out, one row per project that is cut."""
    return capped.where("not kept").groupBy("project").agg(F.min(path_order(F.col("rel_path"))).alias("cut_at"))


def beyond_cut(entries: DataFrame, found: DataFrame) -> tuple[DataFrame, Column]:
    """The entries with the saved cut of their project, and whether an entry lies behind it."""
    joined = measured_join(entries, found, ["project"], spread_on=["rel_path"], how="left")
    return joined, F.coalesce(path_order(F.col("rel_path")) >= F.col("cut_at"), F.lit(False))
