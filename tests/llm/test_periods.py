import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm_helpers import records
from packloom.llm import catalog, periods


def brute(words, least=12):
    """All runs, by comparing every word with the one each period further on."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)]
        at = 0
        while at < len(same):
            end = at
            while end < len(same) and same[end]:
                end += 1
            length = end - at + q
            run = words[at : at + length]
            if end > at and length >= max(least, 2 * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                found.append((at, length, q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def left(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def made(rng, letters, size):
    words = []
    while len(words) < size:
        part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        words += part * rng.choice([1, 1, 2, 3, 7])
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [made(rng, letters, rng.randint(0, 90)) for letters in ("a", "ab", "abc", "abcdefghij") for _ in range(25)]
    assert periods.runs_of(texts) == [brute(t) for t in texts]


def test_longer_least_length():
    words = list("xabcabcabcabcabcabcaby")
    assert periods.runs_of([words], 20) == [brute(words, 20)] == [[(1, 20, 3)]]
    assert periods.runs_of([words], 21) == [[]]
    with pytest.raises(ValueError):
        periods.runs_of([words], 8)


def test_few_suffixes_asked_at_a_time(monkeypatch):
    monkeypatch.setattr(periods, "ASKED", 3)
    rng = random.Random(9)
    texts = [made(rng, "ab", 120) for _ in range(10)]
    assert periods.runs_of(texts) == [brute(t) for t in texts]


def test_long_periodic_texts_and_words_of_fibonacci():
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    assert periods.runs_of([b]) == [brute(b)]
    unit = [f"w{i}" for i in range(3000)]
    assert periods.runs_of([unit * 7, ["same"] * 40000]) == [[(0, 21000, 3000)], [(0, 40000, 1)]]


def test_collapsed_keeps_the_first_period():
    words = "so a b a b a b a b a b a b a b end".split()
    assert periods.collapsed(words, periods.runs_of([words])[0]) == "so a b end".split()


def test_hostile_documents(hostile, nothing):
    rows = records(periods.detect_runs(hostile))
    assert len(rows) == hostile.count()
    texts = {(r["doc_id"], r["text"]) for r in hostile.select("doc_id", "text").collect()}
    want = sorted(
        (str(i), tuple(brute(w)), " ".join(left(w, brute(w))))
        for i, w in ((i, (t or "").encode().decode("utf-8").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")) for i, t in texts)
        for w in [[x for x in w if x]] if len(w) < 2000)
    got = sorted({(str(r["doc_id"]), tuple(map(tuple, r["runs"])), r["collapsed"]) for r in rows if r["n_words"] < 2000})
    assert got == want
    assert periods.detect_runs(nothing).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(120)] + [None, " \t", "one"]
    texts += ["\n".join(made(rng, "abc", 80)) for _ in range(60)]
    rows = [(i - 40, t) for i, t in enumerate(texts)] + [(None, "a " * 30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc_id, text in rows:
        words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        if doc_id is not None and words:
            h = zlib.crc32(str(doc_id).encode())
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            if h % 10 == 0:
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = min(((-n, a, q) for a, n, q in runs), default=None)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        want.append((doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
                     sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(left(words, runs)))))
    got = [tuple(r) for r in catalog.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[1] for r in want)


def test_planting_leaves_other_documents_alone(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(" a  b\tc d e f g\n").alias("text"))
    texts = {r["doc_id"]: r["text"] for r in catalog._planted_periods(docs).collect()}
    plain = {i for i, t in texts.items() if t == "a b c d e f g"}
    assert {i for i in range(200) if zlib.crc32(str(i).encode()) % 10} <= plain != set(texts)
