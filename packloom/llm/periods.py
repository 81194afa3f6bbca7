"""Periodic runs of words: an enhanced suffix array and its branching tandem repeats.

A run is a stretch of consecutive words with smallest period ``q`` and a length of ``least`` words
and of ``2 * q`` or more that no neighbouring word extends keeping the period.  Every document is
looked at by itself and whole, in blocks of bounded text (or of one longer document), so nothing
is shuffled and a task needs memory for a block's words only.

A run of period ``q`` ends in a square of it, two equal neighbouring stretches that the next word
parts: a branching tandem repeat.  Its two halves share exactly as many words as they are long, so
both begin suffixes in one LCP interval of that depth, in different children.  For each interval,
the suffixes of all children but the largest ask through the inverse suffix array whether the
suffix ``depth`` words before or behind lies in the rest of the interval.  Intervals are taken from
the LCP array by a stack, and one of many children as splits into two; no tree nodes are built.
A square found is rotated to the left as far as words allow, which gives the run.

With 12 words or more, a run of any period has such a square of depth ``SEED`` or more (its own,
or one of a multiple of a shorter period), whose halves both begin with a repeated stretch of
``SEED`` words.  So documents without one have no run, and only repeated stretches are sorted.

Null texts have no words, and an empty table gives no rows.  Rows without an id, repeated rows and
ids are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packloom.llm.common import blocks

#: Fewest words of a run, and of the repeated stretches that are sorted.
LEAST, SEED = 12, 4
#: Bytes of text whose suffixes are sorted together, and suffixes that ask at a time.
TEXT_BYTES, ASKED = 2 << 20, 1 << 20

Run = tuple[int, int, int]


def _repeats(symbols: np.ndarray) -> np.ndarray:
    """Which positions begin a stretch of ``SEED`` symbols that may occur again; none that does is left out."""
    mixed = symbols.astype(np.uint64)
    for gap in (1, 2):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) ^ (mixed >> np.uint64(29))
        mixed = mixed[:-gap] * np.uint64(0xBF58476D1CE4E5B9) + mixed[gap:]
    ordered = np.sort(mixed)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    found = np.zeros(len(symbols), bool)
    if len(again):
        place = np.searchsorted(again, mixed)
        place[place == len(again)] = 0
        found[: len(mixed)] = again[place] == mixed
    return found


def _doubled(ranks: np.ndarray, length: int) -> np.ndarray:
    """Ranks of stretches of twice ``length`` from those of ``length``, a rank being the number of smaller ones."""
    size = len(ranks)
    behind = np.full(size, -1, np.int64)
    behind[: size - length] = ranks[length:]
    _, number, counts = np.unique(ranks * np.int64(size + 1) + behind + 1, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - counts)[number]


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that begin with a repeated stretch of ``SEED`` symbols, in order, and the LCP before each.

    The last symbol occurs nowhere else.  A common prefix shorter than ``SEED`` counts as none.
    """
    ranks, length, levels = symbols.astype(np.int64), 1, []
    while length < SEED:
        levels.append((length, ranks.astype(np.int32)))
        ranks, length = _doubled(ranks, length), 2 * length
    counts = np.bincount(ranks, minlength=len(ranks))
    active = kept = np.flatnonzero(counts[ranks] > 1)
    while len(active):
        levels.append((length, ranks.astype(np.int32)))
        # A stretch that occurs twice ends before the last symbol, so what lies behind it has a rank.
        first, second = ranks[active], ranks[active + length]
        order = np.lexsort((second, first))
        active, first, second = active[order], first[order], second[order]
        place = np.arange(len(active))
        group = np.concatenate([[True], first[1:] != first[:-1]])
        part = group | np.concatenate([[True], second[1:] != second[:-1]])
        begins = np.flatnonzero(part)
        of_part = begins[np.cumsum(part) - 1]
        of_group = np.flatnonzero(group)[np.cumsum(group) - 1]
        ranks = ranks.copy()
        ranks[active] = first + of_part - of_group
        sizes = np.diff(np.append(begins, len(active)))
        active, length = active[np.repeat(sizes, sizes) > 1] if len(place) else active, 2 * length
    array = kept[np.argsort(ranks[kept])]
    lcp = np.zeros(len(array) + 1, np.int64)
    left, right, shared = array[:-1].copy(), array[1:].copy(), lcp[1:-1]
    for length, level in reversed(levels):
        same = level[left] == level[right]
        shared += same * length
        left += same * length
        right += same * length
    lcp[lcp < SEED] = 0
    return array, lcp


def _splits(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each place of a positive LCP that splits an interval, with the interval's ends.

    An interval with several children has a place between each two: what is left of a place are
    all children before it, what is right of it is the one child behind it.
    """
    values = lcp.tolist()
    begins, ends, stack = [0] * len(values), [0] * len(values), []
    for at, value in enumerate(values):
        while stack and values[stack[-1]] >= value:
            ends[stack.pop()] = at
        begins[at] = stack[-1] if stack else 0
        stack.append(at)
    places = np.flatnonzero(lcp)
    return places, np.array(begins, np.int64)[places], np.array(ends, np.int64)[places]


def branching_squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and half lengths of all squares of ``SEED`` symbols or more a half that the next symbol parts."""
    array, lcp = suffix_array(symbols)
    place_of = np.full(len(symbols) + 1, -1, np.int64)
    place_of[array] = np.arange(len(array))
    places, begins, ends = _splits(lcp)
    left = places - begins <= ends - places
    first = np.where(left, begins, places)
    counts = np.where(left, places - begins, ends - places)
    low, high, depths = np.where(left, places, begins), np.where(left, ends, places), lcp[places]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    total, at = np.concatenate([[0], np.cumsum(counts)]), 0
    while at < len(counts):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + ASKED, "right")) - 1)
        split = np.repeat(np.arange(at, upto), counts[at:upto])
        suffix = array[first[split] + np.arange(len(split)) - (total[split] - total[at])]
        depth, least, most = depths[split], low[split], high[split]
        for begin, other in ((suffix, suffix + depth), (suffix - depth, suffix - depth)):
            place = place_of[np.where(other < 0, len(symbols), other)]
            inside = (place >= least) & (place < most)
            found.append((begin[inside], depth[inside]))
        at = upto
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _shared_before(symbols: np.ndarray, low: int, begin: int, gap: int) -> int:
    """How many symbols before ``begin``, down to ``low``, equal those ``gap`` further on."""
    shared, step = 0, 16
    while begin - shared > low:
        step = min(step, begin - shared - low)
        stop = begin - shared
        unlike = np.flatnonzero(symbols[stop - step : stop] != symbols[stop - step + gap : stop + gap])
        if len(unlike):
            return shared + step - 1 - int(unlike[-1])
        shared, step = shared + step, 4 * step
    return shared


def _runs(symbols: np.ndarray, low: int, squares: list[tuple[int, int]], least: int) -> list[Run]:
    """The runs that squares, shortest first, belong to: ``(begin, length, period)``."""
    known: dict[int, list[tuple[int, int]]] = {}
    runs = []
    for half, begin in squares:
        end = begin + 2 * half
        # A square of a repeated stretch lies in the run of that stretch, which was found before.
        if any(half % period == 0 and start <= begin for start, period in known.get(end, ())):
            continue
        start = begin - _shared_before(symbols, low, begin, half)
        period = half
        for shorter in range(1, SEED):
            if half % shorter == 0 and np.array_equal(symbols[start : end - shorter], symbols[start + shorter : end]):
                period = shorter
                break
        known.setdefault(end, []).append((start, period))
        if end - start >= max(least, 2 * period):
            runs.append((start - low, end - start, period))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def runs_of(texts: list[list], least: int = LEAST) -> list[list[Run]]:
    """The runs ``(begin, length, period)`` of each list of words, by begin and period."""
    if least < 3 * SEED:
        raise ValueError(f"a run has {3 * SEED} words or more")
    sizes = np.array([len(words) for words in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    hashes = np.zeros(starts[-1], np.int64)
    for number, words in enumerate(texts):
        # Every document has words and an end of its own.
        begin = starts[number]
        hashes[begin : begin + len(words)] = np.fromiter(map(hash, words), np.int64, len(words)) ^ (number * 0x2545F4914F6CDD1D % (1 << 62))
        hashes[begin + len(words)] = hash((number, "end"))
    candidates = np.unique(np.searchsorted(starts, np.flatnonzero(_repeats(hashes)), "right") - 1).tolist()
    found: list[list[Run]] = [[] for _ in texts]
    if not candidates:
        return found
    parts, lows, taken = [], [], 0
    known = 0
    for number in candidates:
        words = texts[number]
        numbers = {word: known + i for i, word in enumerate(dict.fromkeys(words))}
        known += len(numbers) + 1
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([known - 1]))
        lows.append(taken)
        taken += len(words) + 1
    symbols = np.concatenate(parts)
    begins, halves = branching_squares(symbols)
    if not len(begins):
        return found
    order = np.lexsort((begins, halves))
    begins, halves = begins[order], halves[order]
    of = np.searchsorted(np.array(lows), begins, "right") - 1
    for at in np.unique(of).tolist():
        mine = of == at
        found[candidates[at]] = _runs(symbols, lows[at], list(zip(halves[mine].tolist(), begins[mine].tolist(), strict=True)), least)
    return found


def collapsed(words: list, runs: list[Run]) -> list:
    """The words that stay when every run keeps its first period only."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for begin, length, period in runs:
        change[begin + period] += 1
        change[begin + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))


def detect_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document: its runs by start and period, and its text without what they repeat.

    Words are what ASCII white space parts; in the collapsed text one space parts them.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1, TEXT_BYTES):
            texts = [text.split() for text in batch[1].cast(pa.binary()).to_pylist()]
            runs = runs_of(texts, least)
            places = [[{"start": a, "length": n, "period": q} for a, n, q in found] for found in runs]
            left = [b" ".join(collapsed(words, found)) for words, found in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch[0], pa.array(map(len, texts), pa.int64()), pa.array(places, pa.list_(struct)),
                pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS),
                           T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(work, schema)
