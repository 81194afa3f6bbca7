"""Scan options: one literal set for every project, or one resolved row per project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.fixed_values import DEFAULT_MAX_KIB
from packloom.functions.globs import compiled_patterns
from packloom.functions.rules import ColumnRules, LiteralRules
from packloom.operators.joins import measured_join

_FLAGS = ("no_ignore", "tree_no_ignore", "no_tree", "no_blacklist")
_LISTS = ("include", "exclude", "tree_include", "tree_exclude")


@dataclass(frozen=True)
class Rules:
    """What the decisions need of the options, as column expressions over an entry row."""

    include: object
    exclude: object
    tree_include: object
    tree_exclude: object
    no_ignore: Column
    tree_no_ignore: Column
    no_tree: Column
    no_blacklist: Column
    max_kib: Column
    blacklist: tuple[str, ...] = ()


@dataclass(frozen=True)
class ScanConfig:
    """Options shared by every project.  Tree settings left at None follow the content settings.

    ``blacklist`` holds globs beyond the built-in ones, such as the files another tool leaves behind.
    """

    include: str | None = None
    exclude: str | None = None
    tree_include: str | None = None
    tree_exclude: str | None = None
    no_ignore: bool = False
    tree_no_ignore: bool | None = None
    no_tree: bool = False
    no_blacklist: bool = False
    max_size: int = DEFAULT_MAX_KIB
    blacklist: tuple[str, ...] = ()

    def rules(self) -> Rules:
        # An empty tree list is set, and so replaces the content list by "no filter".
        tree_include = self.include if self.tree_include is None else self.tree_include
        tree_exclude = self.exclude if self.tree_exclude is None else self.tree_exclude
        return Rules(
            include=LiteralRules(self.include),
            exclude=LiteralRules(self.exclude),
            tree_include=LiteralRules(tree_include),
            tree_exclude=LiteralRules(tree_exclude),
            no_ignore=F.lit(self.no_ignore),
            tree_no_ignore=F.lit(self.no_ignore if self.tree_no_ignore is None else self.tree_no_ignore),
            no_tree=F.lit(self.no_tree),
            no_blacklist=F.lit(self.no_blacklist),
            max_kib=F.lit(self.max_size).cast("bigint"),
            blacklist=self.blacklist,
        )


def effective_tree_rules(configs: DataFrame) -> DataFrame:
    """Let unset tree settings follow the content settings; an empty list counts as set."""
    return (
        configs.withColumn("tree_include", F.coalesce("tree_include", "include"))
        .withColumn("tree_exclude", F.coalesce("tree_exclude", "exclude"))
        .withColumn("tree_no_ignore", F.coalesce("tree_no_ignore", "no_ignore"))
    )


def compile_configs(resolved: DataFrame) -> DataFrame:
    """One row per project: its pattern lists compiled, and why it is held back, if it is.

    ``config_error`` is the status of a project whose options could not be resolved
    (``config_status`` other than ok), else the first bad glob, else that the project has several
    rows of options.  Such a project fails as a whole, and the others go on.
    """
    status = F.col("config_status") if "config_status" in resolved.columns else F.lit("ok")
    lists = effective_tree_rules(resolved).select(
        "project", "max_size", *_FLAGS, *[compiled_patterns(F.col(c)).alias(f"_{c}") for c in _LISTS],
        F.when(status != "ok", status).alias("_status"))
    errors = F.coalesce("_status", *[F.col(f"_{c}")["error"] for c in _LISTS])
    kept = [c for c in lists.columns if c not in ("project", "_status")]
    one = lists.withColumn("_error", errors).groupBy("project").agg(
        *[F.first(c).alias(c) for c in kept], F.min("_error").alias("_error"), F.count(F.lit(1)).alias("_rows"))
    repeated = F.when(F.col("_rows") > 1, F.lit("several rows of options"))
    return one.withColumn("config_error", F.coalesce("_error", repeated)).drop("_error", "_rows")


def with_configs(entries: DataFrame, compiled: DataFrame) -> DataFrame:
    """Put each project's options on its entries.

    A project without options has the defaults; one that is held back has no rows.  ``compiled``
    is a saved table, few rows next to the entries, which may carry their texts.
    """
    joined = measured_join(entries, compiled, ["project"], spread_on=["rel_path"], how="left")
    default = {**{c: F.coalesce(c, F.lit(False)) for c in _FLAGS}, "max_size": F.coalesce("max_size", F.lit(DEFAULT_MAX_KIB))}
    return joined.where("config_error is null").drop("config_error").withColumns(default)


def without_lists(judged: DataFrame) -> DataFrame:
    """Drop the compiled lists once they have been used; flags and the size limit stay."""
    return judged.drop(*[f"_{c}" for c in _LISTS])


def column_rules() -> Rules:
    """The options :func:`with_configs` put on the rows."""
    lists = {c: ColumnRules(F.col(f"_{c}")) for c in _LISTS}
    return Rules(**lists, **{c: F.col(c) for c in _FLAGS}, max_kib=F.col("max_size"))
