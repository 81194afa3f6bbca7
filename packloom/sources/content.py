"""Reading the bytes of files that survived the rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packloom.functions.content import decode_lossy, is_binary_bytes, is_lossy
from packloom.operators.joins import spread_work
from packloom.sources.directory import os_error_text

_BATCH_BYTES = 32 * 1024 * 1024


def _read_files(batches: Iterator[pa.RecordBatch], opened: Accumulator | None) -> Iterator[pa.RecordBatch]:
    """Replace ``read_error`` and add ``content_bytes``, handing rows on in batches of bounded bytes."""
    for batch in batches:
        place = batch.schema.get_field_index("read_error")
        start, held, errors, contents = 0, 0, [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("_wanted", "location", "read_error")))
        for at, (wanted, location, error) in enumerate(rows, 1):
            data = None
            if wanted:
                try:
                    if opened is not None:
                        opened.add(1)
                    with open(location, "rb") as file:
                        data = file.read()
                except OSError as failure:
                    error = f"read: {os_error_text(failure)}"
            errors.append(error)
            contents.append(data)
            held += len(data or b"")
            if held >= _BATCH_BYTES or at == batch.num_rows:
                part = batch.slice(start, at - start).set_column(place, "read_error", pa.array(errors, pa.string()))
                yield part.append_column("content_bytes", pa.array(contents, pa.binary()))
                start, held, errors, contents = at, 0, [], []


def attach_content(entries: DataFrame, wanted: Column, opened: Accumulator | None = None) -> DataFrame:
    """Add ``content_bytes`` to entries with a ``location``; only ``wanted`` files are opened, and counted in ``opened``.

    A file that cannot be read gets a ``read_error`` instead of failing the task.  Rows are first
    spread evenly by path.
    """
    spread = spread_work(entries.withColumn("_wanted", F.coalesce(wanted, F.lit(False))), "project", "rel_path")
    schema = T.StructType([*spread.schema.fields, T.StructField("content_bytes", T.BinaryType())])
    return spread.mapInArrow(lambda batches: _read_files(batches, opened), schema).drop("_wanted")


def inspect_bytes(entries: DataFrame) -> DataFrame:
    """Turn ``content_bytes`` into ``content``, ``is_binary`` and ``lossy_utf8``."""
    raw = F.col("content_bytes")
    return entries.withColumns({
        "is_binary": is_binary_bytes(raw), "lossy_utf8": is_lossy(raw), "content": decode_lossy(raw),
    }).drop("content_bytes")
