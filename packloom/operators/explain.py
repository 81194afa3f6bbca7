"""Explaining requested paths, and the sentences shown for decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.fixed_values import DECISION_TEXT, SKIP_BINARY, SKIP_DIRECTORY_LINK, SKIP_TOO_LARGE, SKIP_UNREADABLE
from packloom.functions.paths import normalized, prefixes
from packloom.operators.saving import measured, saved

SKIP_TOKEN_CAP = "beyond the token cap"


def decision_text(code: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in DECISION_TEXT.items() for x in pair])
    return F.when(code == "token_cap", F.lit(f"skipped because {SKIP_TOKEN_CAP}")).otherwise(F.try_element_at(texts, code))


def rule_text(code: Column, rule: Column) -> Column:
    """The line naming the rule behind a decision, null for decisions without one."""
    named = lambda label: F.concat(F.lit(f"Rule: {label}"), rule)
    return (
        F.when(code == "blacklist", named("blacklist = "))
        .when(code == "exclude", named("exclude = "))
        .when(code == "include", named("include = "))
        .when(code == "max_size", named(""))
        .when(code == "unreadable", named("read error = "))
    )


def skip_reason(code: Column, max_kib: Column, length: Column, read_error: Column, is_dir: Column) -> Column:
    """Why a file that passed the rules was not attached, null otherwise; a directory is no file, a link to one is."""
    return (
        F.when(code == "max_size", F.format_string(SKIP_TOO_LARGE, max_kib, length))
        .when(code == "binary", F.lit(SKIP_BINARY))
        .when((code == "unreadable") & ~is_dir, F.concat(F.lit(SKIP_UNREADABLE), read_error))
        .when((code == "not_a_file") & ~is_dir, F.lit(SKIP_DIRECTORY_LINK))
        .when(code == "token_cap", F.lit(SKIP_TOKEN_CAP))
    )


def _passed(path: Column) -> Column:
    """The directories a path goes through on detours: before every ``..``, ``.`` and doubled or trailing slash."""
    start = F.struct(F.array().cast("array<string>").alias("at"), F.array().cast("array<string>").alias("passed"))

    def step(state: Column, part: Column) -> Column:
        at, passed = state["at"], state["passed"]
        here = F.concat(passed, F.array(F.array_join(at, "/")))
        up = F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))
        return (
            F.when(part.isin("", "."), F.struct(at.alias("at"), here.alias("passed")))
            .when(part == "..", F.struct(up.alias("at"), here.alias("passed")))
            .otherwise(F.struct(F.concat(at, F.array(part)).alias("at"), passed.alias("passed"))))

    walked = F.aggregate(F.split(path, "/"), start, step)["passed"]
    return F.array_remove(F.array_distinct(walked), "")


def located(requested: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Add ``rel_path`` to ``(project, path)``, the path below the root, null when outside it, and ``passed``.

    ``passed`` are directories that must be there for the path to exist as it is written.
    ``roots`` (project, root) is needed for absolute paths only.
    """
    path = F.col("path")
    if roots is None:
        requested = requested.withColumn("root", F.lit(None).cast("string"))
    else:
        requested = requested.join(roots.select("project", "root"), "project", "left")
    root = F.rtrim("root", F.lit("/"))
    in_root = F.when(path == root, "").when(
        F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))
    inside = F.when(path.startswith("/"), F.coalesce(in_root, F.lit(".."))).otherwise(path)
    placed = requested.withColumn("rel_path", normalized(inside)).withColumn("passed", _passed(inside))
    return placed.withColumn(
        "rel_path", F.when(~F.col("rel_path").rlike(r"\A\.\.(?:/|\z)"), F.col("rel_path"))).drop("root")


def through_links(located_requests: DataFrame, links: DataFrame) -> DataFrame:
    """Follow links to directories on the way: what lies behind one is judged where it really is.

    ``links`` (project, rel_path, real_path) are the links to directories; real_path is null where
    one leads out of the root.  The last component of a path is not followed.  Each round follows
    one link of every path that still has some.
    """
    rows = located_requests
    while True:
        above = rows.select("project", "path", "rel_path", F.explode(prefixes(F.col("rel_path"), with_self=False)).alias("_link")).join(
            links.select("project", F.col("rel_path").alias("_link"), "real_path"), ["project", "_link"])
        first = saved(above.groupBy("project", "path").agg(F.min(F.struct(F.length("_link").alias("n"), "real_path")).alias("_to")))
        if not measured(first)["rows"]:
            return rows
        behind = F.expr("substring(rel_path, _to.n + 1)")
        real = F.when(F.col("_to.real_path") == "", F.substring(behind, F.lit(2), F.length("rel_path"))).otherwise(F.concat("_to.real_path", behind))
        rows = saved(rows.join(first, ["project", "path"], "left").withColumn(
            "rel_path", F.when(F.col("_to").isNull(), F.col("rel_path")).otherwise(real)).drop("_to"))


def asked_keys(located_requests: DataFrame) -> DataFrame:
    """``project, rel_path`` of all that the requests need to know about."""
    keys = located_requests.select("project", F.explode(F.array_compact(F.concat(F.array("rel_path"), "passed"))).alias("rel_path"))
    return keys.distinct()


def explain(located_requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """``project, path`` and code and rule for content and tree, for every requested path.

    ``decisions`` need to cover :func:`asked_keys` only (and directories, and each root as
    ``''``).  A path that is not there, or goes through something that is not a directory, is not
    found, which comes before being outside, and has no tree decision.
    """
    known = decisions.select(
        "project", "rel_path", "content_code", "content_rule", "tree_code", "tree_rule",
        F.coalesce(F.col("link_target") != "", F.lit(True)).alias("found"))
    directories = decisions.where("is_dir").select("project", F.col("rel_path").alias("_passed"))
    broken = (
        located_requests.select("project", "path", F.explode("passed").alias("_passed"))
        .join(directories, ["project", "_passed"], "left_anti").select("project", "path", F.lit(True).alias("_broken")).distinct())
    rows = located_requests.join(known, ["project", "rel_path"], "left").join(broken, ["project", "path"], "left")
    whole = F.col("_broken").isNull()
    outside, found = whole & F.col("rel_path").isNull(), whole & F.coalesce("found", F.lit(False))
    return rows.select(
        "project", "path",
        F.when(outside, "outside_root").when(~found, "not_found").otherwise(F.col("content_code")).alias("content_code"),
        F.when(found, F.col("content_rule")).alias("content_rule"),
        F.when(outside, "outside_root").when(found, F.col("tree_code")).alias("tree_code"),
        F.when(found, F.col("tree_rule")).alias("tree_rule"),
    )


def report(explained: DataFrame) -> DataFrame:
    """The sentences of :func:`explain`'s answers."""
    columns = []
    for side in ("content", "tree"):
        code, rule = F.col(f"{side}_code"), F.col(f"{side}_rule")
        columns += [decision_text(code).alias(f"{side}_result"), rule_text(code, rule).alias(f"{side}_rule")]
    return explained.select("project", "path", *columns)
