"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full sets, and grouping.

A document's set holds its distinct shingles of ``shingle`` words; one with fewer words has its whole
sequence as the one shingle, and one without words is empty and linked with nothing.  Two documents
are linked if the shared part of their sets is ``similarity`` of the union or more, and linked
documents, also over others, form a group.

Documents with equal sets are one from the start, so large groups of copies cost nothing later.
Representatives that share a band of their signatures meet in buckets.  No bucket is expanded into
all its pairs: first every member is compared with one pivot, which joins most of what belongs
together.  Then the members outside a bucket's main group are compared with those of other groups,
in blocks of bounded size: by whole signatures first, and where these come near the similarity by
the sets themselves, so that only links leave a block.  Pairs within a group are never compared.
All links are confirmed on the full sets.

Null texts are empty.  Repeated rows of an id have one group, that of any of their texts.  Rows without an id
make no groups; they show the group of an equal text, if there is one, and are not kept.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.common import blocks, bound_batches, memo_of, written
from packloom.operators.joins import unique_join
from packloom.operators.saving import saved

#: Signature slots are BANDS x BAND_ROWS: two sets of similarity 0.8 miss each other once in 1,500 times.
BANDS, BAND_ROWS = 24, 6
SLOTS = BANDS * BAND_ROWS
#: Signatures agree on this much less than the similarity before a pair is given up, six standard deviations: of pairs at
#: a similarity of 0.8, fewer than one in a million.
MARGIN = 0.2
#: Shingles of a bucket's members that are compared in one block, about.
CHUNK = 1_000_000
#: Elements whose permutations are held in memory at a time.
BLOCK = 200_000
#: Words whose hashes a Python worker remembers, and bytes of a word that is worth it.
MEMO, MEMO_BYTES = 300_000, 40


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z are lower-cased."""
    import xxhash

    words = text.encode().lower().split() if text else []
    memo = memo_of("minhash")
    found = list(map(memo.get, words))
    if None in found:
        for at, (word, value) in enumerate(zip(words, found, strict=True)):
            if value is None:
                found[at] = xxhash.xxh3_64_intdigest(word)
                if len(word) <= MEMO_BYTES:
                    memo[word] = found[at]
        if len(memo) > MEMO:
            memo.clear()
    hashes = np.array(found, np.uint64)
    if not len(hashes):
        return hashes
    width = min(shingle, len(hashes))
    rolled = np.full(len(hashes) - width + 1, width, np.uint64)
    for at in range(width):
        rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[at : len(hashes) - width + 1 + at])
    return np.unique(rolled)


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` values per set.

    Step j gives every element the j-th place of its own random permutation and a value between j
    and j + 1.  A set is done as soon as all its slots hold less than the next step can give.
    """
    signature = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat, places = signature.reshape(-1), None
    for step in range(slots):
        if not len(element):
            break
        drawn = _mix(element + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        pick = ((drawn >> np.uint64(32)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64) + step
        value = (drawn & np.uint64(0xFFFFFFFF)) + np.uint64(step << 32)
        slot = pick if places is None else places[np.arange(len(pick)), pick]
        np.minimum.at(flat, owner * slots + slot, value)
        open_sets = signature.max(axis=1) >= np.uint64(step + 1 << 32)
        stays = open_sets[owner]
        element, owner, pick = element[stays], owner[stays], pick[stays]
        if places is None:
            places = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(element), 1))
        else:
            places = places[stays]
        places[np.arange(len(pick)), pick] = places[:, step]
    return signature


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key per band, the number of the band included."""
    rows = signature.reshape(len(signature), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for at in range(rows.shape[2]):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, at])
    return keys


def _blocks(texts: list[str | None], shingle: int) -> Iterator[list[np.ndarray]]:
    block, size = [], 0
    for text in texts:
        block.append(shingle_set(text, shingle))
        size += len(block[-1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def sketch(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, k1, k2, bands, signature``; k1 and k2 identify the set, and an empty set has only its size.

    The signature is kept as 16 bits a slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in blocks(batches, 1):
            counts, keys, bands, signatures = [], [], [], []
            for sets in _blocks(batch.column(1).to_pylist(), shingle):
                signature = superminhash(sets)
                short = (_mix(signature) >> np.uint64(48)).astype(np.uint16)
                for values, row, slots in zip(sets, band_keys(signature).view(np.int64), short, strict=True):
                    counts.append(len(values))
                    keys.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                    bands.append(row if len(values) else None)
                    signatures.append(slots.tobytes() if len(values) else None)
            halves = [[None if k is None else int.from_bytes(k[at : at + 8], "little", signed=True) for k in keys] for at in (0, 8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), *[pa.array(h, pa.int64()) for h in halves], pa.array(bands, pa.list_(pa.int64())),
                 pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "bands", "signature"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, signature binary")


def sets_of(ids: DataFrame, docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, members`` for the saved ``ids`` (_id); texts of other documents stay in their scan."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1):
            found = [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["_id", "members"])

    return written(unique_join(texts, ids, ["_id"], "inner").select("_id", "text").mapInArrow(sets, "_id bigint, members binary"))


def linked(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough; the texts of documents in no pair stay in their scan."""
    members = sets_of(saved(pairs.selectExpr("explode(array(a, b)) as _id").distinct()), docs, shingle, doc_id, text)
    both = (
        pairs.join(members.select(F.col("_id").alias("b"), F.col("members").alias("mb")), "b")
        .join(members.select(F.col("_id").alias("a"), F.col("members").alias("ma")), "a"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ma", "mb").mapInArrow(confirm, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reached) of all ids in ``edges`` (a, b).

    Alternates two kinds of star contraction until nothing changes: neighbours larger than a node
    move to its smallest neighbour, then smaller ones do.  A node's neighbours are only ever
    summarised by a minimum, never gathered.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    # Done when every edge leads to a root, that is, to a node from which no edge leads on.
    while not edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() or _forked(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v")
        edges = written(moved.distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _forked(edges: DataFrame) -> bool:
    """Does a node still lead to several others?"""
    return not edges.groupBy("u").count().where("count > 1").isEmpty()


def group_documents(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    bound_batches(docs.sparkSession)
    sketched = written(sketch(docs, shingle, doc_id, text))
    groups = written(
        sketched.where(F.col("k1").isNotNull() & F.col("doc_id").isNotNull()).groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"), F.min("signature").alias("signature")))
    rows = groups.select("rep", "n", F.explode("bands").alias("key"))
    # Only buckets in which documents meet go on.
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rep", "n")).alias("first")).where("c > 1").drop("c")
    met = written(rows.join(crowded, "key").where("rep <> first.rep").select("key", "rep", "n", F.col("first.rep").alias("pivot"), F.col("first.n").alias("pn")))
    close = F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn)")
    pairs = written(met.where(close).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    edges = written(linked(pairs, docs, shingle, percent, doc_id, text))
    found = written(components(edges))
    hopeful = written(_contested(met.select("key", "rep"), found, groups, percent))
    if not hopeful.isEmpty():
        sets = sets_of(saved(hopeful.select(F.col("rep").alias("_id")).distinct()), docs, shingle, doc_id, text)
        more = written(_links_of(hopeful, sets, percent))
        if not more.isEmpty():
            found = written(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)))
    named = groups.join(found, groups["rep"] == found["id"], "left").select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.coalesce("component", "rep").alias("_component"))
    return sketched.join(named, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").select(
        "doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _contested(met: DataFrame, found: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The members, by block, that some member of another group may be similar to, by their signatures.

    ``met`` holds the members but the pivots, which have been compared with all.  Members outside
    the largest group of their bucket are *strays*; every stray meets every member of another
    group.  Both sides are dealt into chunks of about ``CHUNK`` shingles.
    """
    placed = met.join(found, met["rep"] == found["id"], "left").select("key", "rep", F.coalesce("component", "rep").alias("group"))
    placed = placed.join(groups.select("rep", "n"), "rep")
    tally = placed.groupBy("key", "group").agg(F.sum("n").alias("c"))
    buckets = tally.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("c").alias("all"), F.max(F.struct("c", "group")).alias("main")).where("n_groups > 1")
    divided = written(placed.join(buckets.select(
        "key", F.col("main.group").alias("home"), F.ceil(F.col("all") / CHUNK).alias("member_chunks"),
        F.ceil((F.col("all") - F.col("main.c")) / CHUNK).alias("stray_chunks")), "key"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    chunk = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    members = divided.select("key", "rep", "group", F.lit(False).alias("stray"), chunk("member_chunks").alias("m"), spread("stray_chunks").alias("s"))
    strays = divided.where("`group` <> home").select(
        "key", "rep", "group", F.lit(True).alias("stray"), spread("member_chunks").alias("m"), chunk("stray_chunks").alias("s"))
    rows = members.union(strays).join(groups.select("rep", "n", "bands", "signature"), "rep").select(*_BLOCK)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 3):
            needed = np.zeros(len(block), bool)
            for x, near in _near(block, percent):
                needed[near] = True
                needed[x] |= len(near) > 0
            if needed.any():
                yield from block.filter(pa.array(needed)).to_batches()

    return rows.repartition("key", "m", "s").sortWithinPartitions("key", "m", "s").mapInArrow(compare, rows.schema)


_BLOCK = ("key", "m", "s", "stray", "rep", "group", "n", "bands", "signature")


def _near(block: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each stray of a block and the members of other groups that its signature comes near to.

    Pairs of two strays appear once, and a pair that shares several bands only in the first.
    """
    rep, group, n = (block[c].to_numpy() for c in ("rep", "group", "n"))
    bands = block["bands"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
    signature = np.frombuffer(b"".join(block["signature"].to_pylist()), np.uint16).reshape(len(rep), -1)
    stray = block["stray"].to_numpy(zero_copy_only=False).astype(bool)
    key, others, strays = block["key"][0].as_py(), np.flatnonzero(~stray), np.flatnonzero(stray)
    is_stray = np.isin(rep[others], rep[strays])
    least = (percent / 100 - MARGIN) * signature.shape[1]
    for x in strays.tolist():
        may = (group[others] != group[x]) & (100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x]))
        y = others[may & (~is_stray | (rep[others] > rep[x]))]
        y = y[(signature[y] == signature[x]).sum(axis=1) >= least]
        yield x, y[bands[x][(bands[y] == bands[x]).argmax(axis=1)] == key]


def _links_of(hopeful: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of the blocks, by their sets; two groups are linked once in a block."""
    rows = hopeful.join(sets, hopeful["rep"] == sets["_id"]).select(*_BLOCK, "members")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 3):
            rep, group = block["rep"].to_numpy(), block["group"].to_numpy()
            sets = [np.frombuffer(m, np.uint64) for m in block["members"].to_pylist()]
            joined, found = set(), []
            for x, near in _near(block, percent):
                for y in near.tolist():
                    if (group[x], group[y]) in joined:
                        continue
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                        joined |= {(group[x], group[y]), (group[y], group[x])}
                        found.append((rep[x], rep[y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*found, strict=True)], ["a", "b"])

    dealt = rows.repartition("key", "m", "s").sortWithinPartitions("key", "m", "s")
    return dealt.mapInArrow(confirm, "a bigint, b bigint").distinct()


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first ``width`` columns of sorted batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        keys = np.column_stack([held.column(c).to_numpy() for c in range(width)])
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            yield held.slice(begin, end - begin)
        held = held.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held
