"""What changed between two snapshots of a corpus, in files and in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.operators.order import number_rows
from packloom.operators.saving import saved

_KEY = ["project", "rel_path"]


def _numbered(files: DataFrame) -> DataFrame:
    """The files with their number among those of their project and content, by path."""
    keyed = files.withColumn("_same", F.to_json(F.struct("project", "digest")))
    return number_rows(keyed, "_same", "rel_path", "_number").drop("_same")


def token_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """``project, rel_path, from_path, change, tokens_before, tokens_after, delta``: one row per file that is not the same.

    Snapshots have ``project, rel_path, digest, tokens``, unique by path.  A path that both have is
    ``changed`` if its content is another one.  Of the paths that one snapshot alone has, those with
    equal content in the same project are ``moved``, from ``from_path`` to ``rel_path``: where several
    files hold the content, the first one gone by path is the first one that came, and so on.  What
    is left was ``added`` or ``removed``.

    Copies of one content are numbered over range partitions and meet by number, so a content that
    much of a project holds is neither paired with all its copies nor gathered in one task.
    """
    old = before.select(*_KEY, F.col("digest").alias("old_digest"), F.col("tokens").cast("bigint").alias("tokens_before"))
    new = after.select(*_KEY, F.col("digest").alias("new_digest"), F.col("tokens").cast("bigint").alias("tokens_after"))
    both = saved(old.join(new, _KEY, "full_outer").where("not (old_digest <=> new_digest)"))
    changed = both.where("old_digest is not null and new_digest is not null").select(
        *_KEY, F.lit(None).cast("string").alias("from_path"), F.lit("changed").alias("change"), "tokens_before", "tokens_after")
    gone = _numbered(both.where("new_digest is null").select("project", "rel_path", F.col("old_digest").alias("digest"), "tokens_before"))
    came = _numbered(both.where("old_digest is null").select("project", "rel_path", F.col("new_digest").alias("digest"), "tokens_after"))
    met = gone.withColumnRenamed("rel_path", "from_path").join(came, ["project", "digest", "_number"], "full_outer")
    change = F.when(F.col("from_path").isNull(), "added").when(F.col("rel_path").isNull(), "removed").otherwise("moved")
    others = met.select(
        "project", F.coalesce("rel_path", "from_path").alias("rel_path"),
        F.when(change == "moved", F.col("from_path")).alias("from_path"), change.alias("change"), "tokens_before", "tokens_after")
    zero = F.lit(0).cast("bigint")
    return changed.unionByName(others).withColumn("delta", F.coalesce("tokens_after", zero) - F.coalesce("tokens_before", zero))


def delta_totals(deltas: DataFrame) -> DataFrame:
    """``project, change, files, delta`` of ``token_deltas``, with totals per project (``change`` null)."""
    return deltas.groupingSets([["project", "change"], ["project"]], "project", "change").agg(
        F.count(F.lit(1)).alias("files"), F.sum("delta").alias("delta"))
