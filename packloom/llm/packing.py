"""Best-fit packing of documents into token sequences.

Documents become pieces of at most ``capacity`` tokens, and pieces are put into bins as they come.
A bucket of pieces has a fixed number of open bins; a bitset tells which amounts of free space they
offer, a piece goes where least space is left over, and when a new bin needs a place the fullest one
closes.  Pieces are dealt to buckets by their hash and come in falling length.  Bins that are still
open and not nearly full at the end of a bucket are packed once more, as single items, in the same
way, so that cutting the work into buckets costs no space.

Null and empty texts are one piece that holds the end id alone.  Repeated rows are packed each; an
empty table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.common import parts_of, written
from packloom.llm.pretokens import number_bytes, prove_whole_tokens, worker_pretokens

#: Rows of a bucket, about, and bins that are open in it at a time.
BUCKET_ROWS = 16_384
OPEN_BINS = 8_192
#: A bin filled to this share is not packed again.
NEARLY_FULL = 0.9

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document's ids, the end id last; ids themselves stay in the task that made them."""
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))
    end = number_bytes([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_pretokens(path, whole.value)
        for batch in batches:
            rows = []
            for key, chunks in zip(batch.column(0).to_pylist(), encoder.values(batch.column(1).to_pylist()), strict=True):
                ids = memoryview(b"".join([*chunks, end]))
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int], set[int]]:
    """Bin and offset of each length in turn, and the bins that are still open at the end."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = made = opened = 0  # spaces: bit f is set if an open bin has f free
    bins, offsets = [], []
    for length in lengths:
        fitting = spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = by_free[free].pop()
            if not by_free[free]:
                spaces ^= 1 << free
        else:
            if opened == open_bins:
                fullest = (spaces & -spaces).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    spaces ^= 1 << fullest
                opened -= 1
            chosen, free = made, capacity
            made, opened = made + 1, opened + 1
        bins.append(chosen)
        offsets.append(capacity - free)
        free -= length
        if free:
            by_free[free].append(chosen)
            spaces |= 1 << free
        else:
            opened -= 1
    return bins, offsets, {b for group in by_free for b in group}


def _packed(items: DataFrame, keys: list[str], capacity: int, bucket_rows: int, open_bins: int) -> DataFrame:
    """Pack the items, whose ``length`` is at most ``capacity``: their ``bin``, ``at`` and ``is_open``."""
    buckets = parts_of(items.count(), bucket_rows)
    order = F.xxhash64(*keys)
    dealt = items.withColumn("_order", order).withColumn("_bucket", F.pmod(F.col("_order"), F.lit(buckets)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "_order", *keys], ascending=False, ignore_index=True)
        bins, offsets, left = best_fit(group["length"].tolist(), capacity, open_bins)
        first = int(group["_bucket"].iloc[0]) << 24
        return group.drop(columns=["_order", "_bucket"]).assign(
            bin=np.asarray(bins, "int64") + first, at=np.asarray(offsets, "int64"), is_open=[b in left for b in bins])

    schema = ", ".join(f"`{c}` {t}" for c, t in items.dtypes) + ", bin bigint, at bigint, is_open boolean"
    return dealt.groupBy("_bucket").applyInPandas(pack, schema)


def pack_pieces(pieces: DataFrame, capacity: int, bucket_rows: int = BUCKET_ROWS, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity``.

    Full pieces are sequences by themselves and pass no shuffle.  Others meet in buckets of about
    ``bucket_rows`` rows; then the bins that were left open are moved, whole, behind one another.
    """
    pieces = written(pieces)
    full = pieces.where(F.col("length") >= capacity).withColumns({
        "sequence_id": F.monotonically_increasing_id() * 3, "offset": F.lit(0).cast("bigint")})
    first = written(_packed(
        pieces.where(F.col("length") < capacity), ["doc_id", "piece", "start", "length", "ids_crc32"], capacity, bucket_rows, open_bins))
    left = written(
        first.where("is_open").groupBy(F.col("bin").alias("from_bin")).agg(F.max(F.col("at") + F.col("length")).alias("length"))
        .where(F.col("length") <= capacity * NEARLY_FULL))
    moved = _packed(left, ["from_bin", "length"], capacity, bucket_rows, open_bins).select(
        "from_bin", F.col("bin").alias("to_bin"), F.col("at").alias("by"))
    placed = first.join(moved, first["bin"] == moved["from_bin"], "left").select(
        *pieces.columns,
        F.coalesce(F.col("to_bin") * 3 + 1, F.col("bin") * 3 + 2).alias("sequence_id"),
        (F.coalesce("by", F.lit(0)) + F.col("at")).alias("offset"))
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, capacity: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces (``doc_id, piece, start, length, ids_crc32``) with ``sequence_id`` and ``offset``."""
    return pack_pieces(cut_pieces(docs, path, capacity, end_id, doc_id, text), capacity)
