import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_helpers import records
from packloom.llm import minhash


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def expected_groups(rows, width, percent=80):
    """Brute force: smallest id reachable over links of any version of an id."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i, _ in sets}


def check(spark, rows, width, parts=3):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    found = records(minhash.group_documents(docs, width))
    want = expected_groups(rows, width)
    sizes = {}
    for i, t in rows:
        sizes.setdefault(i, set()).add(len(shingles(t, width)))
    assert len(found) == len(rows)
    for r in found:
        assert r["n_shingles"] in sizes[r["doc_id"]]
        if r["doc_id"] is None:
            assert not r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    return found


@pytest.mark.parametrize("width", [2, 5])
def test_hostile_texts(spark, hostile, width):
    check(spark, [(r["doc_id"], r["text"]) for r in records(hostile)], width)


def test_groups_of_copies_and_chains(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows, texts = [], []
    for _ in range(40):  # copies with random changes, linked with some of each other
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    chain = list(base)
    for step in range(12):  # each linked with the next only
        chain = [f"c{step}_{j}" for j in range(7)] + chain[7:] if step else chain
        texts.append(" ".join(chain[::-1]))
    texts += [" ".join(base)] * 60 + [" ".join(f"y{rng.randrange(50)}" for _ in range(60)) for _ in range(30)]
    texts += ["shared passage of several common words " * 3 + f"own{i} text{i}" for i in range(40)]
    rng.shuffle(texts)
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)]
    found = check(spark, rows, 2)
    assert sum(r["kept"] for r in found) < len(rows) - 90


@pytest.mark.parametrize("chunk", [30, 1_000_000])
def test_pairs_that_no_pivot_links_are_found(spark, monkeypatch, chunk):
    """One bucket holds everything and signatures are full of hope, so the comparison of strays does all the work."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "MARGIN", 1.0)
    real = minhash.sketch
    monkeypatch.setattr(minhash, "sketch", lambda *args: real(*args).withColumn("bands", F.array(F.lit(1).cast("bigint"))))
    rows = []
    for g in range(6):
        words = [f"g{g}_{j}" for j in range(20)]
        rows += [(100 * g + k, " ".join([*words[k:], *[f"g{g}n{j}" for j in range(k)]])) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in records(minhash.group_documents(docs, 1))}
    assert found == expected_groups(rows, 1)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(6)
    for similarity in (0.3, 0.8):
        errors = []
        for _ in range(60):
            x = rng.integers(0, 2**63, 400, dtype=np.uint64)
            shared = int(round(2 * 400 * similarity / (1 + similarity)))
            y = np.concatenate([x[:shared], rng.integers(0, 2**63, 400 - shared, dtype=np.uint64)])
            a, b = minhash.superminhash([np.unique(x), np.unique(y)])
            errors.append((a == b).mean() - shared / (800 - shared))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (similarity * (1 - similarity) / minhash.SLOTS) ** 0.5 * 1.3


def test_signature_of_a_set_does_not_depend_on_its_batch():
    sets = [np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (1, 2, 50, 5000, 0)]
    together = minhash.superminhash(sets)
    for row, values in zip(together[:4], sets[:4], strict=True):
        assert (minhash.superminhash([values])[0] == row).all()
        assert sorted((minhash.superminhash([values[::-1]])[0] == row).tolist())[0]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 3), (3, 7), (7, 9), (9, 9)]
    found = {r["id"]: r["component"] for r in records(minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")))}
    assert found == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {3: 3, 7: 3, 9: 3}


def test_empty_table(nothing):
    assert minhash.group_documents(nothing).count() == 0


def test_few_pairs_are_given_up_by_their_signatures():
    least = math.ceil((0.8 - minhash.MARGIN) * minhash.SLOTS)
    missed = sum(math.comb(minhash.SLOTS, k) * 0.8**k * 0.2 ** (minhash.SLOTS - k) for k in range(least))
    assert missed < 1e-6
    rng = np.random.default_rng(4)
    one = rng.integers(0, 2**16, minhash.SLOTS).astype(np.uint16)
    other = one.copy()
    other[least:] += 1
    rows = [{"key": 5, "m": 0, "s": 0, "stray": i > 0, "rep": i, "group": i, "n": 50, "bands": [5, 9 + i], "signature": x.tobytes()} for i, x in enumerate((one, other))]
    block = pa.Table.from_pylist(rows)
    assert [(x, near.tolist()) for x, near in minhash._near(block, 80)] == [(1, [0])]
