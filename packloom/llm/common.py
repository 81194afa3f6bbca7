"""What several of the operators need."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.operators.saving import checkpoint_dir


#: Removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on this session hands texts to Python in batches of ``BATCH_BYTES``, if it was asked for no smaller ones.

    A batch is held several times on its way, in the executor and in its Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made and run inside leave no shuffle files behind; what is shuffled there must not be wanted twice."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(rows: DataFrame, **options: str) -> DataFrame:
    """Write ``rows`` into the shared checkpoint folder and read them back.

    It cuts the lineage, outlives lost executors, and a plan that uses the table twice reads it
    twice instead of computing it twice.  What was shuffled for it is not needed any more, so it is
    removed at once instead of when the driver happens to collect its garbage.
    """
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        rows.write.parquet(path, **options)
    found = spark.read.schema(rows.schema).parquet(path)
    found.folder = path
    return found


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`written` gave, once nothing will read it again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id has none."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus)).cast("int")


def held_out(doc_id: str | Column, modulus: int, value: int) -> Column:
    """Is the row's remainder this one?  A row without an id is not held out."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def parts_of(rows: int, at_most: int) -> int:
    """Into how many parts rows go so that a part holds about ``at_most``."""
    return max(1, -(-rows // at_most))


#: Bytes of text that a Python worker takes apart at a time.
BLOCK_BYTES = 4 << 20


def blocks(batches: Iterator[pa.RecordBatch], text: int, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``size`` bytes of text, or of one longer text.

    ``text`` is the number of a column of texts, or of one that has their lengths.
    """
    for batch in batches:
        column = batch.column(text)
        lengths = pc.fill_null(column if pa.types.is_integer(column.type) else pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        place = np.cumsum(lengths) // size
        edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if end > begin:
                yield batch.slice(begin, end - begin)


_remembered: dict[str, dict] = {}


def memo_of(operator: str) -> dict:
    """What this Python worker remembers for an operator.

    Workers are used again by later stages.  One remembers for one operator at a time, so that the
    memos of a pipeline's stages do not pile up in it.
    """
    if operator not in _remembered:
        _remembered.clear()
        _remembered[operator] = {}
    return _remembered[operator]
