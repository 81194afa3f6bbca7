"""Exact token counts from a user's merge ranks: byte pairs merged by rank, once per distinct piece of a batch.

The encoding's pattern cuts a text into pieces that are encoded by themselves.  Texts have far fewer
distinct pieces than pieces, so a task merges the distinct ones of a batch of files and remembers
their counts for the next batches.  Pieces never leave the task that cut them: to count each but
once in the cluster, all of them would pass a shuffle, which costs many times their merges.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A rank file goes to all tasks, so it may have this many bytes at most.
RANK_BYTES = 64 << 20
#: Pieces whose counts a task remembers: beyond them it starts anew, and merges a piece again when it meets it.
REMEMBERED = 500_000
#: Longest piece that is remembered, in bytes: longer ones hardly come again.
REMEMBERED_PIECE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a file with a token, in base 64, and its rank on each line."""
    with open(path, "rb") as file:
        content = file.read(RANK_BYTES + 1)
    if len(content) > RANK_BYTES:
        raise ValueError(f"rank files have {RANK_BYTES} bytes at most: {path}")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def count_merged(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of a piece: of all neighbours that make a token, those of the least rank are merged, the first ones first.

    A heap of the pairs keeps long pieces cheap.  A byte without a rank counts as a token of its own.
    """
    size = len(piece)
    if size < 2 or piece in ranks:
        return min(size, 1)
    # A part is known by where it begins; its end is where the next one begins.
    ends, begins, alive = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size
    heap: list[tuple[int, int, int]] = []

    def offer(begin: int) -> None:
        if begin >= 0 and ends[begin] < size:
            end = ends[ends[begin]]
            rank = ranks.get(piece[begin:end])
            if rank is not None:
                heapq.heappush(heap, (rank, begin, end))

    for begin in range(size - 1):
        offer(begin)
    count = size
    while heap:
        _, begin, end = heapq.heappop(heap)
        middle = ends[begin]
        # Pairs that were merged otherwise since are out of date.
        if not alive[begin] or middle >= size or ends[middle] != end:
            continue
        alive[middle], ends[begin] = False, end
        if end < size:
            begins[end] = begin
        count -= 1
        offer(begins[begin])
        offer(begin)
    return count


def pieces_of(text: Column, pattern: str) -> Column:
    """The text's pieces; classes of the pattern are meant as Unicode defines them."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


class PieceCounts:
    """Token counts of pieces, remembered within bounds."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known = ranks, {}

    def of_distinct(self, pieces: pa.Array) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, counts = self.known, np.zeros(len(pieces), np.int64)
        for i, piece in enumerate(pieces.cast(pa.binary()).to_pylist()):
            count = known.get(piece)
            if count is None:
                count = count_merged(piece, self.ranks)
                if len(piece) <= REMEMBERED_PIECE:
                    known[piece] = count
            counts[i] = count
        return counts

    def of_lists(self, lists: pa.Array) -> np.ndarray:
        """The sum of each list of pieces, 0 for null."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        tokens = self.of_distinct(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        sums = np.concatenate([[0], np.cumsum(tokens)])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def exact_tokens(files: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``project, rel_path, content_tokens``: tokens of every file's ``content`` under the ranks and the piece pattern.

    The ranks go to all tasks; nothing is shuffled.  A null or empty content has no tokens.  Strings
    of special tokens are ordinary text.
    """
    sent = files.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts.of_lists(batch.column(2)), pa.int64())], ["project", "rel_path", "content_tokens"])

    cut = files.select("project", "rel_path", pieces_of(F.col("content"), pattern).alias("pieces"))
    schema = T.StructType([*cut.schema.fields[:2], T.StructField("content_tokens", T.LongType())])
    return cut.mapInArrow(work, schema)
