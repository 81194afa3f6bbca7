import hashlib
import random
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from llm_helpers import records
from packloom.llm import fingerprints

NOTHING, LOW = fingerprints.NOTHING, fingerprints.PLACE_BITS + 1


def spark_hash(*values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return struct.unpack("<q", struct.pack("<Q", seed))[0]


def anchors(text):
    """Each distinct anchor's first position."""
    hashes = [spark_hash(w) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    found = {}
    for i, last in enumerate(hashes):
        first, middle = (hashes[i - back] if i >= back else NOTHING for back in (2, 1))
        if middle >= min(first, last):
            found.setdefault((spark_hash(first, middle, last) % 2**64) >> LOW, i)
    return found


def likeness(a, b):
    if a == b:
        return 1.0
    gaps = Counter(b[h] - a[h] for h in a.keys() & b.keys())
    return 2 * sum(n for n in gaps.values() if n >= fingerprints.CHAIN) / (len(a) + len(b))


def digest(found):
    numbers = sorted(struct.unpack("<q", struct.pack("<Q", (h << LOW) | (i << 1)))[0] for h, i in found.items())
    again = spark_hash(*numbers, seed=xxhash.xxh64_intdigest(struct.pack("<i", fingerprints.K), 42))
    return f"{spark_hash(*numbers) % 2**64:016x}{again % 2**64:016x}-{len(found)}"


def expected(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    texts = {i: min((t for j, t in rows if j == i), key=str.encode) for i in ids}
    out = []
    for i, text in rows:
        following = "" if i is None else texts[ids[(ids.index(i) + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed = anchors(text), anchors(edited)
        out.append((
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(own), digest(changed), round(likeness(own, changed), 12),
            0.0 if i is None else round(likeness(own, anchors(following)), 12)))
    return sorted(map(str, out))


def found(frame):
    return sorted(str((*list(r.values())[:5], round(r["near_edited"], 12), round(r["near_next"], 12))) for r in records(fingerprints.fingerprint(frame)))


def test_equals_brute_force(hostile):
    assert found(hostile) == expected([(r["doc_id"], r["text"] or "") for r in records(hostile)])


def test_many_buckets_equal_brute_force(spark, monkeypatch):
    """Ids far apart and negative, copies, moved passages, and buckets of a few rows, found over two look-ups."""
    for name, value in (("BUCKET_BYTES", 2000), ("FANOUT", 3)):
        monkeypatch.setattr(fingerprints, name, value)
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv".split()) + rng.choice("xyz") for _ in range(n))
    passage = prose(60)
    rows = [(rng.randint(-(2**62), 2**62), (prose(rng.randint(0, 30)) + " " + passage if i % 3 else prose(rng.randint(0, 200)))) for i in range(150)]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == expected(rows)


def test_one_id_may_hold_most_rows(spark):
    rows = [(7, f"copy {i % 5} of the text " * 3) for i in range(400)] + [(i, f"own words {i} here it is") for i in range(20)] + [(None, "no id at all")] * 30
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == expected(rows)


def test_half_of_a_text_of_any_length_is_half_the_likeness(spark):
    """No length changes the rule: texts just below and above a dozen words, too."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([n for n in (6, 9, 10, 11, 12, 13, 20, 100) for _ in range(40)])]
    rows += [(1000, " ".join(word() for _ in range(500)))]
    near = {r["doc_id"]: r["near_edited"] for r in records(fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string")))}
    for at, n in enumerate((6, 9, 10, 11, 12, 13, 20, 100)):
        mean = sum(near[i] for i in range(40 * at, 40 * at + 40)) / 40
        assert 0.3 < mean < 0.65, (n, mean)


def test_shuffled_words_are_not_alike_and_a_moved_passage_is(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    mixed = rng.sample(words, 200)
    rows = [(1, " ".join(words)), (2, " ".join(["x", "y"] * 9 + words)), (3, " ".join(mixed)), (4, " ".join(words[100:] + words[:100]))]
    near = {r["doc_id"]: r["near_next"] for r in records(fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string")))}
    assert near[1] > 0.85 and near[2] < 0.05 and near[3] < 0.05 and near[4] > 0.9


def test_halves_are_nearer_than_strangers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    frame = fingerprints.fingerprint(docs).toPandas()
    long = frame[frame["n_chars"] > 1500]
    assert long["near_edited"].mean() > 0.45 and long["near_next"].mean() < 0.01
    assert frame.groupby("fingerprint").size().max() < 60


def test_anchors_move_with_their_passage(spark):
    passage = " ".join(f"p{i * 7 % 31}" for i in range(31))
    rows = spark.createDataFrame([(passage,), ("other words before it " + passage,)], "text string")
    first, second = (
        {(n >> LOW): (n >> 1) % (1 << fingerprints.PLACE_BITS) for n in r["a"]} for r in records(rows.select(fingerprints.anchors(F.col("text")).alias("a"))))
    inner = {h: p for h, p in first.items() if p >= 2}
    assert len(inner) > 10 and {h: p + 4 for h, p in inner.items()}.items() <= second.items()


def test_single_row_and_empty_table(spark, nothing):
    one = records(fingerprints.fingerprint(spark.createDataFrame([(5, "a b c d")], "doc_id bigint, text string")))[0]
    assert one["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()
    assert one["near_next"] == 1.0
    assert fingerprints.fingerprint(nothing).count() == 0


def test_texts_move_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plan = fingerprints.fingerprint(docs)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan
