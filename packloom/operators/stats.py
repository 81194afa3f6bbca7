"""Per-project counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.content import estimated_tokens
from packloom.operators.config import Rules
from packloom.operators.decide import SKIPPED, link_error
from packloom.operators.render import block_tokens, included, trees


def walk_error_count(rules: Rules) -> Column:
    """Walk errors an entry stands for.

    A link out of the root counts once, when content looks at it.  A directory that cannot be
    listed counts once per walk that reaches it: one for content, one for the tree.
    """
    in_content = rules.no_ignore | ~F.col("ignored")
    in_tree = ~rules.no_tree & (rules.tree_no_ignore | ~F.col("ignored"))
    bad_link = link_error() & in_content & F.col("passes_filters") & ~F.col("is_output")
    bad_dir = F.col("is_dir") & F.col("read_error").isNotNull()
    return bad_link.cast("bigint") + F.when(
        bad_dir, in_content.cast("bigint") + in_tree.cast("bigint")).otherwise(0)


def walk_errors(decided: DataFrame, rules: Rules) -> DataFrame:
    return decided.groupBy("project").agg(F.sum(walk_error_count(rules)).alias("walk_errors"))


def output_tokens(decided: DataFrame, outline: DataFrame, tokens=estimated_tokens) -> DataFrame:
    """``project, output_tokens``: tree, and per file its opening, content and closing."""
    of_files = decided.where(included("content")).select(
        "project", block_tokens(F.col("rel_path"), F.col("content_tokens"), tokens).alias("n"))
    return of_files.unionByName(tree_tokens(outline, tokens)).groupBy("project").agg(F.sum("n").alias("output_tokens"))


def tree_tokens(outline: DataFrame, tokens=estimated_tokens) -> DataFrame:
    """``project, n``: tokens of every line of the trees."""
    # A newline always ends a token piece before the drawing of the next line, so the tree's
    # count is the sum over its lines and no project's tree has to be one value.
    return trees(outline).select("project", tokens(F.concat("line", F.lit("\n"))).alias("n"))


def run_stats(decided: DataFrame, outline: DataFrame, rules: Rules, tokens=estimated_tokens) -> DataFrame:
    """``project, files_processed, files_skipped, output_tokens``, in one pass over the files.

    Files the rules reject are not "skipped"; files that reading rejects, and walk errors, are.
    """
    zero = F.lit(0).cast("bigint")
    skipped = (F.col("content_code").isin(*SKIPPED) & ~F.col("is_dir")).cast("bigint")
    block = block_tokens(F.col("rel_path"), F.col("content_tokens"), tokens)
    of_files = decided.select(
        "project", included("content").cast("bigint").alias("processed"),
        (skipped + walk_error_count(rules)).alias("skipped"), F.when(included("content"), block).otherwise(0).alias("n"))
    of_trees = tree_tokens(outline, tokens).select("project", zero.alias("processed"), zero.alias("skipped"), "n")
    return of_files.unionByName(of_trees).groupBy("project").agg(
        F.sum("processed").alias("files_processed"), F.sum("skipped").alias("files_skipped"),
        F.sum("n").alias("output_tokens"))


def token_rollup(decided: DataFrame, tokens=estimated_tokens) -> DataFrame:
    """Files and tokens by project, top directory, extension and decision, with all subtotals.

    ``level`` is Spark's grouping id: 0 for the finest rows, 1, 3 and 7 where the decision, the
    extension and the top directory are summed up as well, 15 for the grand total.  A file at the
    top has the top directory ``''``; one without a dot behind its name's first character the extension ``''``.
    """
    path, block = F.col("rel_path"), block_tokens(F.col("rel_path"), F.col("content_tokens"), tokens)
    top = F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("")
    files = decided.where("not is_dir").select(
        "project", top.alias("top_dir"), F.regexp_extract(path, r"(?s)[^/](\.[^./]*)\z", 1).alias("extension"),
        F.col("content_code").alias("code"), F.when(included("content"), block).otherwise(0).alias("n"))
    return files.rollup("project", "top_dir", "extension", "code").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("files"), F.sum("n").alias("block_tokens"))
