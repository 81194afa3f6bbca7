"""Document fingerprints from closed syncmers over words, matched by position, in DataFrame operations only.

A window of ``K`` words is an anchor if, of the hashes of its words, the least stands first or last.
That depends on the window alone, so texts that share a passage share its anchors wherever it
stands.  Every word of a text ends one window, the first ones with nothing in the places before the
text, so the one rule holds for texts of any length, and a text with a word has an anchor.

Two texts are compared by all their anchors and their positions.  Shared anchors count where they
are collinear: at least ``CHAIN`` of them, the same number of words apart in both texts.  The
likeness is twice that number by the number of both texts' distinct anchors; equal fingerprints are 1.
A fingerprint is a digest of all anchors with their positions.

Null texts are empty ones.  The next document is the one with the next larger id; of several rows
with that id, the least text.  Rows without an id have no next document: half of them is cut off and
their ``near_next`` is 0.  Repeated rows each get a row.  An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.common import written
from packloom.operators.joins import measured_join, unique_join
from packloom.operators.order import running_sums
from packloom.operators.saving import saved

SPACE = r"[\x20\x09-\x0D]+"
#: Words of a window, and shared anchors that make a chain.
K, CHAIN = 3, 2
#: Stands for the hash of a word before the text.
NOTHING = 2**63 - 1
#: An anchor is one number: its hash, and in the low bits its position and which of two texts it is from.
PLACE_BITS = 24
#: Bytes of text that are put beside their next documents together; such groups at most.
BUCKET_BYTES, MAX_BUCKETS, FANOUT = 4 << 20, 1 << 17, 256


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def anchors(text: Column) -> Column:
    """All distinct anchors of a text in the order of their hashes, each at its first position."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of_hashes(h: Column) -> Column:
        def window(x: Column, i: Column) -> Column:
            first, middle = (F.when(i >= back, F.get(h, i - back)).otherwise(F.lit(NOTHING)) for back in (2, 1))
            number = F.shiftleft(F.shiftrightunsigned(F.xxhash64(first, middle, x), PLACE_BITS + 1), PLACE_BITS + 1)
            place = F.shiftleft(F.pmod(i, F.lit(1 << PLACE_BITS)).cast("bigint"), 1)
            return F.when(middle >= F.least(first, x), number.bitwiseOR(place))

        return F.sort_array(F.filter(F.transform(h, window), lambda a: a.isNotNull()))

    def firsts(found: Column) -> Column:
        return F.filter(found, lambda a, i: (i == 0) | (F.shiftright(a, PLACE_BITS + 1) != F.shiftright(F.get(found, i - 1), PLACE_BITS + 1)))

    return _bound(_bound(hashes, of_hashes), firsts)


def likeness(a: Column, b: Column) -> Column:
    """Share of the anchors of two texts that both have, collinear."""
    place = lambda x: F.shiftright(x, 1).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    side = lambda x: F.lit(1) - 2 * x.bitwiseAND(F.lit(1).cast("bigint"))
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(1).cast("bigint")))))

    def shared(merged: Column) -> Column:
        def apart(x: Column, i: Column) -> Column:
            """How many words further the anchor stands in the second text, if the next one is the same from there."""
            other = F.get(merged, i + 1)
            same = F.shiftright(x, PLACE_BITS + 1) == F.shiftright(other, PLACE_BITS + 1)
            return F.when(same, side(x) * (place(other) - place(x)))

        return F.sort_array(F.filter(F.transform(merged, apart), lambda d: d.isNotNull()))

    def chained(gaps: Column) -> Column:
        return F.size(F.filter(gaps, lambda d, i: (d == F.get(gaps, i + CHAIN - 1)) | ((i > 0) & (d == F.get(gaps, i - 1)))))

    total = F.size(a) + F.size(b)
    near = 2.0 * _bound(_bound(both, shared), chained) / total
    return F.when(a == b, F.lit(1.0)).when(total > 0, F.coalesce(near, F.lit(0.0))).otherwise(F.lit(0.0))


def digest(found: Column) -> Column:
    """A fingerprint's text: two 64-bit hashes of all anchors, and their number."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(found)), half(F.xxhash64(F.lit(K), found)), F.lit("-"), F.size(found).cast("string"))


def buckets_of(ids: DataFrame) -> list[int]:
    """The first id of every bucket: runs of ids whose texts have about ``BUCKET_BYTES``, at most ``MAX_BUCKETS`` of them."""
    summed = saved(running_sums(ids.select(F.lit(0).alias("_all"), "doc_id", "bytes"), "_all", ["doc_id"], {"before": "bytes"}))
    total = summed.agg(F.max(F.col("before") + F.col("bytes"))).first()[0] or 0
    size = max(BUCKET_BYTES, -(-total // MAX_BUCKETS))
    first = summed.groupBy(F.floor(F.col("before") / size).alias("bucket")).agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in first.select("first").collect())


def bucket_of(doc_id: Column, firsts: list[int]) -> tuple[Column, Column]:
    """Number of the bucket that an id falls into, and whether it is its bucket's first id; two short look-ups."""
    groups = [firsts[at : at + FANOUT] for at in range(0, len(firsts), FANOUT)]
    listed = lambda values, kind: F.from_json(F.lit(json.dumps(values)), kind)
    coarse = F.size(F.filter(listed([g[0] for g in groups], "array<bigint>"), lambda b: b <= doc_id)) - 1
    group = F.get(listed(groups, "array<array<bigint>>"), coarse)
    fine = F.size(F.filter(group, lambda b: b <= doc_id)) - 1
    return coarse * FANOUT + fine, F.get(group, fine) == doc_id


def with_next(rows: DataFrame, firsts: list[int]) -> DataFrame:
    """Add ``next_text`` and ``next_own`` to rows of unique ids ``doc_id, text``, and their anchors ``own``.

    Texts move once, to the buckets of their ids, in which the next row is one window step away.
    The first text of each bucket also goes to the bucket before it, as a guest behind its rows.
    """
    number, leads = bucket_of(F.col("doc_id"), firsts)
    placed = rows.withColumns({"_bucket": number, "_leads": leads})
    visit = lambda bucket, guest: F.struct(bucket.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    visits = F.when(F.col("_leads"), F.array(
        visit(F.col("_bucket"), False), visit(F.pmod(F.col("_bucket") - 1, F.lit(len(firsts))), True))).otherwise(F.array(visit(F.col("_bucket"), False)))
    dealt = placed.select("doc_id", "text", F.explode(visits).alias("v")).select("doc_id", "text", "v.bucket", "v.guest").repartition("bucket")
    beside = Window.partitionBy("bucket").orderBy("guest", "doc_id")
    known = dealt.withColumn("own", anchors(F.col("text")))
    return known.withColumns({"next_text": F.lead("text").over(beside), "next_own": F.lead("own").over(beside)}).where("not guest").drop("bucket", "guest")


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they and the next document are."""
    every = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = every.where(F.col("doc_id").isNotNull())
    ids = written(named.groupBy("doc_id").agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.count(F.lit(1)).alias("times")))
    nothing = {"next_text": F.lit("").cast("string"), "next_own": F.lit(None).cast("array<bigint>")}
    unnamed = every.where(F.col("doc_id").isNull()).withColumns({"own": anchors(F.col("text")), **nothing})
    firsts = buckets_of(ids)
    if not firsts:
        return _compared(unnamed)
    repeated = saved(ids.where("times > 1").select("doc_id"))
    if not repeated.measured["rows"]:
        return _compared(with_next(named, firsts).unionByName(unnamed))
    # Of the rows of an id, the least text stands for it; the others take its next document.
    several = unique_join(named, repeated, ["doc_id"], "left_semi")
    single = unique_join(named, repeated, ["doc_id"], "left_anti")
    following = with_next(single.unionByName(several.groupBy("doc_id").agg(F.min("text").alias("text"))), firsts)
    of_repeated = saved(unique_join(following, repeated, ["doc_id"], "left_semi").select("doc_id", "next_text", "next_own"))
    others = measured_join(several, of_repeated, ["doc_id"], spread_on=["text"]).withColumn("own", anchors(F.col("text")))
    alone = unique_join(following, repeated, ["doc_id"], "left_anti")
    return _compared(alone.unionByName(others).unionByName(unnamed))


def _compared(rows: DataFrame) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = rows.withColumn("edited", edited).withColumn("changed", anchors(F.col("edited")))
    return made.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("own")).alias("fingerprint"), digest(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        F.coalesce(likeness(F.col("own"), F.col("next_own")), F.lit(0.0)).alias("near_next"))
