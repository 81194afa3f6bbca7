"""Hard negatives: Fagin's threshold algorithm over integer inner products.

Every component becomes ``floor(256 * x)``; a row's score for an anchor is their inner product, in
integers.  An anchor's positives are its best other rows of the same label.  For each positive a
window of scores lies below the positive's own, and the best rows of other labels within the
window are the positive's hard negatives.  Higher scores come first, then smaller ids.

Candidates lie in blocks.  A block has one list of its rows per dimension, sorted by component.
For an anchor, the lists are read together from the end that the sign of the anchor's component
makes the better one.  A row that turns up is scored at once by random access.  The components at
the depth reached bound the score of all rows not seen yet, the threshold, and reading stops when
for every window the threshold lies strictly below the last score kept (then no tie is missed
either) or below the window.  What a task has kept from its earlier blocks counts for the next ones.

Anchors are a stated set that meets all rows, in groups of ``ANCHOR_BYTES`` that are broadcast, one
after the other; a task returns no more rows an anchor than are asked for, whatever it has read.

Rows with a null label, a null vector or any null or non-finite component take no part.  Rows of one
id are rows of their own, also as anchors; rows without an id are no anchors and come after others of
their score.  Vectors of different lengths meet in the components both have.  Scores are exact; one
beyond the range of long is shown as the end of that range.  An empty table gives no rows, and other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.llm.common import parts_of, written
from packloom.operators.saving import checkpoint_dir

#: Rows of a block and its bytes, bytes of the anchors that are broadcast together, first depth read.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
ANCHOR_BYTES, FIRST_DEPTH = 8 << 20, 64
_EXACT, _LONG = 2.0**53, 2**63 - 1


class Block:
    """Candidates and their sorted lists."""

    def __init__(self, rows: list[dict]):
        self.size, self.width = len(rows), max(len(r["vector"]) for r in rows)
        self.row = np.array([r["row"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows])
        self.nameless = np.array([r["vec_id"] is None for r in rows])
        self.id = np.array([0 if r["vec_id"] is None else r["vec_id"] for r in rows], np.int64)
        self.vectors = np.zeros((self.size, self.width))
        for at, r in enumerate(rows):
            self.vectors[at, : len(r["vector"])] = r["vector"]
        self.order = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(self.vectors.T), self.order, axis=1)
        self.largest = float(np.abs(self.vectors).max(initial=0))

    def reader(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | float]]:
        """Rows in the order the lists bring them up, their scores, and the threshold after them."""
        anchor = anchor[: self.width]
        exact = self.largest * float(np.abs(anchor).sum()) < _EXACT
        whole = (lambda x: x) if exact else _wide
        vectors, coefficients = whole(self.vectors[:, : len(anchor)]), whole(anchor)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, depth, step = np.zeros(self.size, bool), 0, FIRST_DEPTH
        while depth < self.size:
            upto = min(self.size, depth + step)
            before = seen.copy()
            if len(up) + len(down):
                seen[self.order[up, self.size - upto : self.size - depth].ravel()] = True
                seen[self.order[down, depth:upto].ravel()] = True
            else:
                seen[depth:upto] = True
            new = np.flatnonzero(seen & ~before)
            bound = (whole(self.sorted[up, self.size - upto]) * coefficients[up]).sum() + (whole(self.sorted[down, upto - 1]) * coefficients[down]).sum()
            scores = vectors[new] @ coefficients if len(anchor) else np.zeros(len(new))
            depth, step = upto, 2 * step
            yield new, scores.astype(np.int64) if exact else scores, int(bound)


def _wide(values: np.ndarray) -> np.ndarray:
    """The whole numbers as integers of any size."""
    return np.array([int(v) for v in values.ravel().tolist()], object).reshape(values.shape)


@dataclass
class Wanted:
    """The best rows with scores from ``low`` to ``high`` percent of ``score``, or of any score."""

    count: int
    score: int | None = None
    low: int = 0
    high: int = 0

    def __post_init__(self):
        self.scores = np.zeros(0, np.int64)
        self.keys = np.zeros((0, 3), np.int64)  # has no id, id, row

    def offer(self, block: Block, rows: np.ndarray, scores: np.ndarray) -> None:
        if self.score is not None:
            inside = (100 * scores >= self.low * self.score) & (100 * scores <= self.high * self.score)
            rows, scores = rows[inside], scores[inside]
        if not len(rows):
            return
        keys = np.stack([block.nameless[rows].astype(np.int64), block.id[rows], block.row[rows]], axis=1)
        self.scores, self.keys = np.concatenate([self.scores, scores]), np.concatenate([self.keys, keys])
        best = np.lexsort((self.keys[:, 2], self.keys[:, 1], self.keys[:, 0], -self.scores))[: self.count]
        self.scores, self.keys = self.scores[best], self.keys[best]

    def settled(self, threshold: int) -> bool:
        """Can no row with a score up to the threshold change what is kept?"""
        if len(self.scores) == self.count and threshold < self.scores[-1]:
            return True
        return self.score is not None and (100 * threshold < self.low * self.score or self.low * self.score > self.high * self.score)


def search(blocks: Iterator[Block], anchors: list[dict], wanted: list[list[Wanted]], same_label: bool) -> None:
    """Offer every block's rows to what is wanted for each anchor, until the threshold settles it."""
    vectors = [np.array(a["vector"], float) for a in anchors]
    for block in blocks:
        for anchor, vector, mine in zip(anchors, vectors, wanted, strict=True):
            for rows, scores, threshold in block.reader(vector):
                fits = (block.label[rows] == anchor["label"]) == same_label
                fits &= block.row[rows] != anchor["row"]
                for window in mine:
                    window.offer(block, rows[fits], scores[fits])
                if all(window.settled(threshold) for window in mine):
                    break


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if held and (len(held) >= BLOCK_ROWS or size > BLOCK_BYTES):
                yield Block(held)
                held, size = [], 0
            held.append(row)
            size += 8 * len(row["vector"])
    if held:
        yield Block(held)


def _groups(anchors: DataFrame) -> Iterator[list[dict]]:
    """The anchors in groups of bounded bytes."""
    held, size = [], 0
    for row in anchors.toLocalIterator():
        bytes_of = 8 * len(row["vector"]) + 200
        if held and size + bytes_of > ANCHOR_BYTES:
            yield held
            held, size = [], 0
        held.append(row.asDict(recursive=True))
        size += bytes_of
    if held:
        yield held


_FOUND = "anchor_row bigint, anchor_id bigint, positive_rank int, positive_id bigint, positive_score bigint, vec_id bigint, row bigint, score bigint"


def _searched(spark: SparkSession, candidates: DataFrame, anchors: DataFrame, same_label: bool, count: int, low: int = 0, high: int = 0) -> DataFrame:
    """The best rows per task of every anchor, or of each of its ``windows``."""
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    spark.createDataFrame([], _FOUND).write.parquet(path)
    for group in _groups(anchors):
        sent = spark.sparkContext.broadcast(group)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            group = sent.value
            windows = [a.get("windows") or [None] for a in group]
            wanted = [[Wanted(count) if w is None else Wanted(count, w["score"], low, high) for w in mine] for mine in windows]
            search(_blocks(batches), group, wanted, same_label)
            rows = [
                (a["row"], a["vec_id"], w and w["rank"], w and w["vec_id"], w and w["score"], None if nameless else vec_id, row,
                 max(-_LONG - 1, min(_LONG, int(score))))
                for a, mine, kept in zip(group, windows, wanted, strict=True) for w, found in zip(mine, kept, strict=True)
                for score, (nameless, vec_id, row) in zip(found.scores, found.keys.tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _FOUND.split(", ")])

        candidates.mapInArrow(work, _FOUND).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(_FOUND).parquet(path)


def integer_vectors(vectors: DataFrame, label: Column, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``row, vec_id, label, vector`` of the rows that take part: whole numbers, held as doubles, and a number of its own for each row.

    A factor of 256 is exact in doubles; a component that it takes beyond them counts as not finite.
    """
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # From 2**53 on doubles are whole numbers, and floor() would give longs, which end earlier.
    whole = lambda x: F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
        F.transform(F.col(vector), lambda x: x.cast("double") * 256).alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return written(rows.withColumn("vector", F.transform("vector", whole)).withColumn("row", F.monotonically_increasing_id()))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: negatives of every anchor and positive.

    ``rows`` are ``integer_vectors``; ``anchor`` says which are anchors.  Negatives score from
    ``low`` to ``high`` percent of their positive.
    """
    spark = rows.sparkSession
    anchors = rows.where(F.coalesce(anchor, F.lit(False)) & F.col("vec_id").isNotNull())
    count = rows.count()
    cores = spark.sparkContext.defaultParallelism
    # One block a task if there are few; more only where every core has several.
    candidates = rows.repartition(max(min(cores, parts_of(count, BLOCK_ROWS // 4)), parts_of(count, BLOCK_ROWS)), "row")
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")]
    best = _searched(spark, candidates, anchors, True, positives)
    placed = best.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_row").orderBy(*order))).where(F.col("rank") <= positives)
    windows = placed.groupBy(F.col("anchor_row").alias("row")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("windows"))
    searching = written(anchors.join(windows, "row"))
    found = _searched(spark, candidates, searching, False, negatives, low, high)
    place = F.row_number().over(Window.partitionBy("anchor_row", "positive_rank").orderBy(*order))
    return found.withColumn("rank", place).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
