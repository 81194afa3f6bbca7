"""Tables written once and used several times, so that no plan repeats the work behind them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session may fall back to its own."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.startswith("local"):
        import tempfile

        folder = tempfile.mkdtemp(prefix="packloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return folder


def _row_bytes(schema: T.StructType) -> Column:
    """Size of a row: texts and bytes by their length, plain values by a fixed number, the rest as JSON."""
    total = F.lit(16)
    for field in schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total += F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total += F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
        else:
            total += 8
    return total


def saved(rows: DataFrame) -> DataFrame:
    """Write ``rows`` below the checkpoint folder and read them back.

    Like a checkpoint it cuts the lineage and outlives executors; as parquet it is also
    compressed, read by column, and of known size when Catalyst picks a join.  Rows and bytes are
    counted while writing (``measured``).
    """
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark)}/packloom-{uuid.uuid4().hex}"
    counts = Observation()
    rows.observe(
        counts, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_row_bytes(rows.schema)), F.lit(0)).alias("bytes")
    ).write.parquet(path)
    _written.append(path)
    table = spark.read.schema(rows.schema).parquet(path)
    table.measured = counts.get
    return table


def measured(table: DataFrame) -> dict[str, int]:
    """``rows`` and ``bytes`` of a table; free for a saved one, one job for any other."""
    known = getattr(table, "measured", None)
    if known is None:
        known = table.agg(
            F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_row_bytes(table.schema)), F.lit(0)).alias("bytes")
        ).first().asDict()
    return known


def discard_saved(spark: SparkSession) -> None:
    """Delete the tables saved so far, once nothing that uses them will run again."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    while _written:
        path = path_of(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
