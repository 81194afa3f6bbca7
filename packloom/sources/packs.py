"""Writing packs as text files, one folder per project, in parts of even size; and publishing whole runs at once."""

from __future__ import annotations

import uuid
from bisect import bisect_right

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.operators.joins import measured_join
from packloom.operators.order import running_sums
from packloom.operators.saving import saved

PLACE = ["project", "section", "path_order"]
#: Bytes of a part; parts of a run at most, whose first places are sent to all tasks; bytes that are worth a task of their own.
PART_BYTES, MAX_PARTS, LEAST_BYTES = 128 << 20, 10_000, 1 << 20
_MANIFEST = "version bigint, project string, run string, rows bigint, bytes bigint"


def _require_parent(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    parent = hadoop.Path(path).getParent()
    if parent is not None and not parent.getFileSystem(spark._jsc.hadoopConfiguration()).exists(parent):
        raise FileNotFoundError(f"Output directory does not exist: {parent}")


def outline_of(rows: DataFrame) -> DataFrame:
    """Place and bytes of every row, with the bytes of all rows before it, saved: what parts are planned from."""
    narrow = rows.select(F.lit(0).alias("_all"), *PLACE, F.octet_length("value").cast("bigint").alias("bytes"))
    return saved(running_sums(narrow, "_all", PLACE, {"before": "bytes"}).drop("_all"))


def part_number(outline: DataFrame, parts: int | None) -> tuple[int, Column]:
    """How many parts there are, and a row's part by its place: all parts hold about the same bytes.

    The first place of each part, ``MAX_PARTS`` at most, goes to all tasks.
    """
    total = outline.agg(F.max(F.col("before") + F.col("bytes"))).first()[0] or 0
    cores = outline.sparkSession.sparkContext.defaultParallelism
    if parts is None:
        parts = max(-(-total // PART_BYTES), min(cores, -(-total // LEAST_BYTES)), 1)
    parts = min(parts, MAX_PARTS)
    # A part holds the rows whose middle falls into its share of the bytes.
    share = F.least(F.floor((F.col("before") + F.col("bytes") / 2) * parts / max(total, 1)), F.lit(parts - 1)).cast("int")
    first = outline.groupBy(share.alias("part")).agg(F.min(F.struct(*PLACE)).alias("first"))
    begins = sorted((tuple(r["first"]), r["part"]) for r in first.collect())
    places, numbers = [b[0] for b in begins], [b[1] for b in begins]

    @F.arrow_udf("int")
    def part(project: pa.Array, section: pa.Array, path_order: pa.Array) -> pa.Array:
        keys = zip(project.to_pylist(), section.to_pylist(), path_order.to_pylist(), strict=True)
        return pa.array([numbers[bisect_right(places, key) - 1] for key in keys], pa.int32())

    return parts, part(*PLACE)


def _write(rows: DataFrame, outline: DataFrame, path: str, parts: int | None) -> None:
    parts, number = part_number(outline, parts)
    # The writer ends every row with a newline of its own, so each value gives up its last one.
    lines = F.expr("substring(value, 1, length(value) - 1)")
    (
        rows.repartitionById(parts, number).sortWithinPartitions(*PLACE).select("project", lines.alias("value"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").text(path)
    )


def write_packs(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """Write the rows of ``render.pack`` below ``path``.

    A project's files read in name order are its pack, byte for byte.  Parts are planned from the
    rows' places and sizes alone, so that all hold about the same bytes, whatever the projects'
    sizes; then texts are shuffled once, each row to its part.  Small projects share a task and a
    huge one spans many files.  Tasks write to a staging folder and a project's folder is replaced
    only when the whole job commits: a failed run leaves the old packs as they were.  Projects not
    in ``rows`` are left alone.
    """
    _require_parent(rows.sparkSession, path)
    _write(rows, outline_of(rows), path, parts)


def publish_packs(rows: DataFrame, path: str, parts: int | None = None) -> int:
    """Write the packs into a folder of their own below ``path`` and make all of them visible at once; gives the version.

    What is published is what the last version of the manifest lists: one row per project with the
    run that wrote it.  The manifest's next version is one file, which appears by one rename when
    every pack is written.  A run that fails anywhere before leaves the last version in force, for
    all its projects.  Projects not in ``rows`` keep their runs.  One writer at a time.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    _require_parent(spark, path)
    outline = outline_of(rows)
    _write(rows, outline, f"{path}/runs/run={run}", parts)
    written = saved(outline.groupBy("project").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).withColumn("run", F.lit(run)))
    old = read_manifest(spark, path)
    version = (old.agg(F.max("version")).first()[0] or 0) + 1
    others = old.join(written.select("project"), "project", "left_anti").select("project", "run", "rows", "bytes")
    manifest = written.select("project", "run", "rows", "bytes").unionByName(others)
    manifest.select(F.lit(version).cast("bigint").alias("version"), "project", "run", "rows", "bytes").coalesce(1).write.mode("append").parquet(
        f"{path}/manifest")
    return version


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``version, project, run, rows, bytes`` of the last version, or of an earlier one; empty where nothing was published."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
        rows = saved(rows)  # what is read now stays what it is, whatever is published next
    except AnalysisException:
        rows = spark.createDataFrame([], _MANIFEST)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == F.lit(version))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``project, place, value`` of the lines of written packs; within a project lines sort by ``place``."""
    found = spark.read.schema("value string, project string").option("lineSep", "\n").text(folder)
    return found.select("project", F.struct(
        "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("place"), "value")


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``project, place, value`` of the lines of the published packs."""
    manifest = saved(read_manifest(spark, path, version).select("project", "run"))
    found = spark.read.schema("value string, run string, project string").option("lineSep", "\n").text(f"{path}/runs")
    lines = found.select("project", "run", F.struct(
        "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("place"), "value")
    return measured_join(lines, manifest, ["project", "run"], spread_on=["value"]).select("project", "place", "value")
