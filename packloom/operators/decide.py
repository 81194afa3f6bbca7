"""Content and tree decisions of every entry: a reason code and the rule behind it.

Entries have ``project, rel_path, is_dir, is_file, length, read_error, is_binary, lossy_utf8``
and, from a directory source, ``link_target, root``.  Missing columns mean "no such fact".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.paths import link_escapes
from packloom.functions.rules import filter_code, filter_rule, too_large
from packloom.operators.config import Rules
from packloom.operators.joins import unique_join

INCLUDED = ["included", "included_lossy"]
SKIPPED = ["max_size", "binary", "unreadable", "not_a_file", "token_cap"]


def with_facts(entries: DataFrame) -> DataFrame:
    """Fill in the facts an entry table does not carry, and those it has left null."""
    no, nothing = F.lit(False), F.lit(None)
    flags = {name: no for name in ("is_dir", "is_binary", "lossy_utf8", "ignored", "is_output")}
    texts = {name: nothing.cast("string") for name in ("read_error", "link_target", "root")}
    have = set(entries.columns)
    filled = {n: F.coalesce(F.col(n), default) if n in have else default for n, default in flags.items()}
    filled["is_file"] = F.coalesce(F.col("is_file"), ~filled["is_dir"]) if "is_file" in have else ~filled["is_dir"]
    missing = {n: default for n, default in (texts | {"length": nothing.cast("bigint")}).items() if n not in have}
    return entries.withColumns(filled | missing)


def with_links_to(outputs: DataFrame, entries: DataFrame) -> DataFrame:
    """The outputs, what those among them that are links lead to, and all links that lead to either: the same files."""
    inside = F.expr("substring(link_target, length(rtrim('/', root)) + 2)")
    links = entries.where(F.col("link_target").isNotNull() & ~link_error()).select(
        "project", F.col("rel_path").alias("_link"), inside.alias("rel_path"))
    outputs = outputs.select("project", "rel_path")
    targets = links.join(outputs.withColumnRenamed("rel_path", "_link"), ["project", "_link"]).select("project", "rel_path")
    files = outputs.unionByName(targets).distinct()
    found = links.join(files, ["project", "rel_path"])
    return files.unionByName(found.select("project", F.col("_link").alias("rel_path")))


def marks_of(ignored: DataFrame | None, outputs: DataFrame | None) -> DataFrame | None:
    """``project, rel_path, ignored, is_output`` of the entries in either set; None without sets."""
    marks = [
        keys.select("project", "rel_path", F.lit(i == 0).alias("ignored"), F.lit(i == 1).alias("is_output"))
        for i, keys in enumerate((ignored, outputs)) if keys is not None
    ]
    if not marks:
        return None
    both = marks[0] if len(marks) == 1 else marks[0].unionByName(marks[1])
    return both.groupBy("project", "rel_path").agg(F.max("ignored").alias("ignored"), F.max("is_output").alias("is_output"))


def with_marks(entries: DataFrame, marks: DataFrame | None) -> DataFrame:
    """Put saved marks on the entries by one join on the entry key, which is unique on both sides."""
    if marks is None:
        return entries
    marked = unique_join(entries.drop("ignored", "is_output"), marks, ["project", "rel_path"], "left")
    return marked.fillna(False, ["ignored", "is_output"])


def exclude_outputs(entries: DataFrame, outputs: DataFrame) -> DataFrame:
    """Drop each project's current output files; nothing can switch this off."""
    return entries.join(outputs.select("project", "rel_path"), ["project", "rel_path"], "left_anti")


def link_error() -> Column:
    """A link that leads out of the root, or nowhere."""
    return link_escapes(F.col("link_target"), F.col("root"))


def inspection_code(rules: Rules) -> Column:
    """What looking at the file itself says, once the rules let it in."""
    early_error = F.coalesce(F.col("read_error").startswith("metadata: "), F.lit(False))
    return (
        F.when(early_error & ~F.col("is_dir"), "unreadable")
        .when(~F.col("is_file"), "not_a_file")
        .when(too_large(F.col("length"), rules.max_kib), "max_size")
        .when(F.col("read_error").isNotNull(), "unreadable")
        .when(F.col("is_binary"), "binary")
        .when(F.col("lossy_utf8"), "included_lossy")
        .otherwise("included")
    )


def inspection_rule(code: Column, rules: Rules) -> Column:
    size = F.format_string("max-size = %d KiB, actual = %d bytes", rules.max_kib, F.col("length"))
    return F.when(code == "max_size", size).when(code == "unreadable", F.col("read_error"))


def judge(entries: DataFrame, rules: Rules) -> DataFrame:
    """Add code and rule for content and tree as far as a row alone can tell: no shuffle.

    ``entries`` have their facts (see :func:`with_facts`).  For the tree, size, bytes and encoding never matter.
    """
    path = F.col("rel_path")
    content = filter_code(path, rules.include, rules.exclude, rules.no_blacklist, rules.blacklist)
    tree = filter_code(path, rules.tree_include, rules.tree_exclude, rules.no_blacklist, rules.blacklist)
    content_code, tree_code = F.col("content_code"), F.col("tree_code")
    return entries.withColumns({
        "content_code": F.when(content != "included", content).otherwise(inspection_code(rules)),
        "tree_code": F.when(rules.no_tree, "tree_disabled").otherwise(tree),
    }).withColumns({
        "content_rule": F.coalesce(
            filter_rule(content_code, path, rules.include, rules.exclude, rules.blacklist), inspection_rule(content_code, rules)),
        "tree_rule": filter_rule(tree_code, path, rules.tree_include, rules.tree_exclude, rules.blacklist),
    })


def apply_marks(judged: DataFrame, rules: Rules) -> DataFrame:
    """Final decisions: current output, then outside links, then blacklist, then ignore, then the rest."""
    content, tree = F.col("content_code"), F.col("tree_code")
    stays = ~F.col("is_output")
    no_link = ~link_error()
    content_ignored = F.col("ignored") & ~rules.no_ignore & (content != "blacklist")
    tree_ignored = F.col("ignored") & ~rules.tree_no_ignore & ~tree.isin("tree_disabled", "blacklist")
    return judged.withColumns({
        # The filters let the entry in, whatever looking at it said; walk errors need to know.
        "passes_filters": ~content.isin("blacklist", "exclude", "include"),
        "content_code": F.when(~stays, "current_output").when(~no_link, "outside_root")
        .when(content_ignored, "ignore").otherwise(content),
        "content_rule": F.when(stays & no_link & ~content_ignored, F.col("content_rule")),
        "tree_code": F.when(~stays, "current_output").when(tree_ignored, "ignore").otherwise(tree),
        "tree_rule": F.when(stays & ~tree_ignored, F.col("tree_rule")),
    })


def decide(entries: DataFrame, rules: Rules) -> DataFrame:
    """Fill in facts, judge, and apply marks that are already on the rows."""
    return apply_marks(judge(with_facts(entries), rules), rules)
