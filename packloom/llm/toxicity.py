"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 64-bit hashes of a word, of two neighbours, and of two words with one between them;
each counts once per document.  All features that enough sampled documents hold become coordinates.
Shards of the sample run the per-coordinate updates side by side, their states are averaged, and
the next round starts from there.  The L1 part leaves few weights, which are broadcast.

Null texts score as empty ones.  Rows without a label teach nothing; an id labelled twice teaches
its larger label, and one with several rows its least text; with no usable labels every score is 0.5 or the share of label 1.  Repeated
rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm.common import blocks, bound_batches, memo_of, written
from packloom.llm.quality import sample_labelled

#: Bounds of the fit: labelled documents, and documents that a coordinate needs.
FIT_ROWS = 20_000
LEAST_DOCS = 5
SHARDS, ROUNDS = 4, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2.0, 0.0

#: Words whose hashes a Python worker remembers, and characters of a word that is worth it: some 15 MB.
MEMO, MEMO_CHARS = 100_000, 40
#: Bytes of text whose features are taken together: they need some forty times as much memory.
TEXT_BYTES = 512 << 10
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FILTER_BITS = 22


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.lower().strip(EDGE))


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and how many words each text has."""
    flat, counts, memo = [], [], memo_of("toxicity")
    for text in texts:
        words = text.split() if text else []
        found = list(map(memo.get, words))
        if None in found:
            for at, (word, value) in enumerate(zip(words, found, strict=True)):
                if value is None:
                    found[at] = _word_hash(word)
                    if len(word) <= MEMO_CHARS:
                        memo[word] = found[at]
            if len(memo) > MEMO:
                memo.clear()
        flat.append(np.array(found, np.uint64))
        counts.append(len(found))
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint64)), np.array(counts, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(texts: list[str | None], keep=None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text: text numbers and hashes; ``keep`` picks hashes worth sorting."""
    words, counts = _hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    found = []
    for gap, factor in ((0, 0), (1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if gap and len(words) <= gap:
            continue
        hashes = words if not gap else _mixed(words[:-gap] * np.uint64(factor) + words[gap:])
        same = None if not gap else doc[:-gap] == doc[gap:]
        chosen = np.ones(len(hashes), bool) if keep is None else keep(hashes)
        if same is not None:
            chosen &= same
        at = np.flatnonzero(chosen)
        found.append((doc[at], hashes[at]))
    docs, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    first = np.ones(len(docs), bool)
    first[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[first], hashes[first]


@dataclass(frozen=True)
class SparseModel:
    """Sorted hashes, their weights, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    @property
    def learned(self) -> bool:
        """Does any feature tell texts apart?  If not, all have the same score."""
        return len(self.weights) > 0

    def scorer(self):
        """A function from texts to probabilities; a bitmap turns almost all features away."""
        size, shift = 1 << FILTER_BITS, np.uint64(64 - FILTER_BITS)
        bitmap = np.zeros(size, bool)
        bitmap[self.hashes >> shift] = True

        def score(texts: list[str | None]) -> np.ndarray:
            docs, hashes = features(texts, lambda h: bitmap[h >> shift])
            place = np.searchsorted(self.hashes, hashes)
            place[place == len(self.hashes)] = 0
            hit = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
            logits = np.bincount(docs[hit], weights=self.weights[place[hit]], minlength=len(texts)) + self.bias
            return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))

        return score


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The proximal step in closed form: 0 where L1 holds a coordinate back."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn(rows: Iterator[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over rows of (coordinates, label), in place."""
    for at, label in rows:
        w = _weights(z[at], n[at])
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        more = n[at] + g * g
        z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
        n[at] = more


def train_ftrl(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None,
               rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> SparseModel:
    """Fit on a bounded sample: what reaches the driver is a row per coordinate, a feature of ``LEAST_DOCS`` documents of the sample."""
    spark = docs.sparkSession
    bound_batches(spark)
    # However many rows an id has, it teaches once, by its least text: the bound on ids is one on rows.
    once = sample_labelled(docs, labels, label, learn, rows, doc_id, text).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sample = written(once.repartition(SHARDS, F.xxhash64("doc_id", "text")))
    balance = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not balance[0] or balance[1] in (0, balance[0]):
        share = (float(balance[1] or 0) + 1) / (balance[0] + 2)
        return SparseModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    known = _coordinates(sample)
    place = spark.sparkContext.broadcast(known)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = place.value
        for batch in blocks(batches, 0, TEXT_BYTES):
            texts = batch.column(0).to_pylist()
            docs_at, found = features(texts)
            spot = np.searchsorted(hashes, found)
            hit = (spot < len(hashes)) & (hashes[np.minimum(spot, max(0, len(hashes) - 1))] == found) if len(hashes) else np.zeros(len(found), bool)
            ends = np.searchsorted(docs_at[hit], np.arange(len(texts) + 1))
            # 0 is the bias, which begins every list.
            spots = np.insert((spot[hit] + 1).astype(np.int32), ends[:-1], 0)
            offsets = pa.array((ends + np.arange(len(ends))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(spots)), batch.column(1)], ["at", "label"])

    indexed = written(sample.select("text", "label").mapInArrow(index, "at array<int>, label int"))
    place.destroy()
    size = len(known) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))

        def shard(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            z, n = (x.copy() for x in state.value)
            for batch in batches:
                lists, labels = batch.column(0), batch.column(1).to_pylist()
                edges, spots = lists.offsets.to_numpy(), lists.values.to_numpy()
                _learn(((spots[a:b], label) for a, b, label in zip(edges[:-1], edges[1:], labels, strict=True)), z, n)
            at = np.flatnonzero(n != state.value[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(z[at] - state.value[0][at]), pa.array(n[at] - state.value[1][at])], ["at", "z", "n"])

        moved = indexed.mapInArrow(shard, "at bigint, z double, n double").groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))
        change = moved.toArrow()
        at = change["at"].to_numpy()
        z[at] += change["z"].to_numpy() / SHARDS
        n[at] += change["n"].to_numpy() / SHARDS
        state.destroy()
    w = _weights(z, n)
    kept = np.flatnonzero(w[1:])
    return SparseModel(known[kept], w[1:][kept], float(w[0]))


def _coordinates(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of all features that ``LEAST_DOCS`` sampled documents hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 0, TEXT_BYTES):
            hashes, counts = np.unique(features(batch.column(0).to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["hash", "n"])

    counted = sample.select("text").mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    frequent = counted.where(F.col("n") >= LEAST_DOCS).select("hash")
    return np.sort(frequent.toArrow()["hash"].to_numpy().view(np.uint64))


def score_column(spark: SparkSession, model: SparseModel, text: str) -> Column:
    sent = spark.sparkContext.broadcast(model)
    made = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(sent.value.scorer())
        parts = blocks([pa.RecordBatch.from_arrays([texts], ["text"])], 0, TEXT_BYTES)
        return pa.array(np.concatenate([np.zeros(0), *[made[0](p.column(0).to_pylist()) for p in parts]]))

    return score(F.col(text))


def score_toxicity(docs: DataFrame, model: SparseModel, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = docs.select(
        F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), score_column(docs.sparkSession, model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
