import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_helpers import records
from packloom.llm import catalog, neighbours, suffix_tree
from packloom.llm.common import held_out, written
from packloom.operators.saving import checkpoint_dir


def tokens(text):
    return [*(text or "").encode().lower().split(), suffix_tree.END]


def check_base(docs, found):
    rows = [(r["doc_id"], r["text"]) for r in records(docs)]
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not out[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), out[i], len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
         round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    mine = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found)
    assert [m[:5] for m in mine] == [e[:5] for e in expected]
    assert all(abs(m[5] - e[5]) < 1e-4 for m, e in zip(mine, expected, strict=True))


@pytest.mark.parametrize("frequent", [10, 300_000])
def test_base_of_hostile_texts(hostile, monkeypatch, frequent):
    monkeypatch.setattr(suffix_tree.most_frequent, "__defaults__", (frequent,))
    monkeypatch.setattr(suffix_tree, "HELD", 50)
    out = held_out("doc_id", 7, 2)
    check_base(hostile, records(suffix_tree.score(hostile, ~out, out)))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = catalog.op6_lm_scoring(spark, "/root/testdata/sf0.01")
    rows = records(found)
    check_base(docs, rows)
    base, model = (sum(r[c] for r in rows if r["held_out"]) for c in ("base_score", "score"))
    assert model > 0.98 * base


def brute_scores(texts, learned):
    """The tree by its definition, with dictionaries: log10 of every text."""
    streams = [tokens(t) for t in texts]
    training = [s for s, use in zip(streams, learned, strict=True) if use]
    counts = Counter(w for s in training for w in s)
    n, v = sum(counts.values()), len(counts)
    follows = {}
    for s in training:
        for i, w in enumerate(s):
            for k in range(1, suffix_tree.DEPTH + 1):
                if i >= k:
                    follows.setdefault(tuple(s[i - k : i]), Counter())[w] += 1
    nodes, grown = {(): None}, {()}

    def probability(past, w):
        p = (counts[w] + 1) / (n + v + 1)
        for k in range(1, suffix_tree.DEPTH + 1):
            node = nodes.get(tuple(past[len(past) - k :])) if k <= len(past) else None
            if node:
                p = node[0].get(w, 0.0) + node[1] * p
        return p

    for k in range(1, suffix_tree.DEPTH + 1):
        found = {}
        for context, after in follows.items():
            # A context has been seen often enough, as has the pair that makes it.
            if len(context) != k or context[:-1] not in grown:
                continue
            seen = counts[context[0]] if k == 1 else follows[context[:-1]][context[-1]]
            if seen < suffix_tree.CONTEXT or suffix_tree.END in context:
                continue
            listed = {w: c for w, c in after.items() if c >= suffix_tree.NEXT}
            share = {w: (c - suffix_tree.DISCOUNT) / seen for w, c in listed.items()}
            rest = 1 - sum(share.values())
            whole = {w: probability(context[1:], w) for w in listed}
            gain = sum(c * math.log((share[w] + rest * whole[w]) / whole[w]) for w, c in listed.items())
            unlisted = seen - sum(listed.values())
            found[context] = (share, rest) if (gain + unlisted * math.log(max(rest, 1e-12))) / seen >= suffix_tree.DIVERGENCE else None
        nodes |= found
        grown |= set(found)
    return [sum(math.log10(probability(s[:i], w)) for i, w in enumerate(s)) for s in streams], sum(x is not None for x in nodes.values())


def test_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    phrases = [[rng.choice(words) for _ in range(6)] for _ in range(8)]
    texts = [" ".join(w for _ in range(rng.randint(1, 20)) for w in (rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(words), f"own{i}"])) for i in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, "w1"), (502, "never seen")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(suffix_tree, "PAIRS", 100)
    monkeypatch.setattr(suffix_tree, "SCORED", 7)
    for frequent in (300_000, 20):  # with 20, most words have no number: they are in no context and never listed
        monkeypatch.setattr(suffix_tree.most_frequent, "__defaults__", (frequent,))
        learn = F.col("doc_id") < 100
        got = {r["doc_id"]: r["score"] for r in records(suffix_tree.score(docs, learn, ~learn))}
        want, nodes = brute_scores([t for _, t in rows], [i < 100 for i, _ in rows])
        assert nodes > 50
        if frequent > 20:
            assert all(abs(got[i] - s) < 1e-6 * max(1, abs(s)) for (i, _), s in zip(rows, want, strict=True))
        else:
            assert all(math.isfinite(x) for x in got.values())


@pytest.mark.parametrize("entries, bits", [(2_000_000, 29), (40, 29), (5, 10), (0, 10)])
def test_successors_that_do_not_fit_count_all_the_same(spark, monkeypatch, entries, bits):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    phrases = [[rng.choice(words) for _ in range(7)] for _ in range(9)]
    texts = [" ".join(w for _ in range(rng.randint(1, 20)) for w in (rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(words)])) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(suffix_tree, "ENTRIES", entries)
    monkeypatch.setattr(suffix_tree, "FILTER", bits)
    learn = F.col("doc_id") < 100
    got = {r["doc_id"]: r["score"] for r in records(suffix_tree.score(docs, learn, ~learn))}
    want, nodes = brute_scores(texts, [i < 100 for i in range(120)])
    assert nodes > 50
    assert all(abs(got[i] - s) < 1e-6 * abs(s) for i, s in enumerate(want))


def test_the_tree_grows_with_the_texts(spark):
    nodes = []
    for folder in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").withColumn("learn", F.lit(True))
        tree, *_ = suffix_tree.train(docs)
        nodes.append(sum(int(level.node.sum()) for level in tree.levels))
    assert nodes[1] > 2.5 * nodes[0] > 0


def test_more_successors_than_fit(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "ENTRIES", 5)
    docs = spark.createDataFrame([(i, "a b a b a b a c a d a e x y z " * 5) for i in range(9)], "doc_id bigint, text string")
    tree, *_ = suffix_tree.train(docs.withColumn("learn", F.lit(True)))
    assert all(len(level.entries) <= 5 for level in tree.levels) and tree.levels[0].node.any()


def test_distributions_sum_to_one_and_know_contexts(spark):
    text = "a b c . a b d . " * 40 + "x y " * 30 + "rare"
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id bigint, text string")
    tree, rare, _ = suffix_tree.train(docs.withColumn("learn", F.lit(True)))
    assert rare.count() == 0 and len(tree.levels) >= 2 and tree.levels[0].node.any()
    words = list(tree.numbers)
    for past in ("a b", "x", "c", ". a b", "zzz", ""):
        total = 0.0
        for nxt in [*words, "\n"]:
            numbers = [0, *[tree.numbers.get(w.encode() if isinstance(w, str) else w, -1) for w in past.split()]]
            numbers.append(0 if nxt == "\n" else tree.numbers[nxt])
            total += 10 ** tree.log_scores(np.array(numbers))[-1]
        # What is left is what the root keeps for one unknown word.
        assert 0.95 < total <= 1 + 1e-9
    after = lambda past, w: tree.log_scores(np.array([0, *[tree.numbers[x.encode()] for x in past.split()], tree.numbers[w]]))[-1]
    assert after("x", b"y") > -0.1 and after("b", b"c") > after("x", b"c")


def test_no_training_rows(hostile, nothing):
    found = records(suffix_tree.score(hostile, F.lit(False), F.lit(True)))
    assert len(found) == hostile.count()
    assert all((r["score"], r["base_score"], r["n_known"], r["train_tokens"]) == (0.0, 0.0, 0, 0) for r in found)
    assert suffix_tree.score(nothing, F.lit(True), F.lit(False)).count() == 0


def test_pairs_are_packed_and_added(spark):
    """Pairs whose numbers exceed 64 bits together, in far fewer bytes than three numbers; what is packed in parts adds up."""
    rng = np.random.default_rng(15)
    c, w = rng.choice(rng.integers(1, 300_001**3, 500), 20_000), rng.integers(0, 300_001, 20_000)
    w[::3] = 300_000
    counted = Counter(zip(c.tolist(), w.tolist(), strict=True))
    got, size = Counter(), 0
    for half in (slice(0, 9_000), slice(9_000, None)):
        batch = suffix_tree._packed(*suffix_tree._merged(c[half], w[half]), 7)
        size += batch.nbytes
        for data, pairs in zip(batch["data"].to_pylist(), batch["size"].to_pylist(), strict=True):
            for a, b, n in zip(*map(np.ndarray.tolist, suffix_tree._unpacked(data, pairs)), strict=True):
                got[a, b] += n
    assert got == counted and size < 8 * len(counted)
    assert [len(x) for x in suffix_tree._merged(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0]


def test_a_task_adds_part_by_part_in_one_worker(spark):
    """Pairs come sorted by part, and what follows one word needs no second Python worker beside the one that adds."""
    docs = spark.createDataFrame([(i, "a b a c d " * 5) for i in range(9)], "doc_id bigint, text string")
    tree, _, numbered = suffix_tree.train(docs.withColumn("learn", F.lit(True)))
    pairs = suffix_tree.count_pairs(numbered, tree, 1, None)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Sort [part" in plan
    found = {(r["c"], r["w"]): (r["n"], r["total"], r["whole"]) for r in records(pairs)}
    a, b = tree.numbers[b"a"], tree.numbers[b"b"]
    assert found[a, b] == (45, 90, 46 / (9 * 26 + 6)) and found[b, a][:2] == (45, 45)


def test_the_driver_keeps_no_level_and_no_table_of_the_training(spark):
    """Levels and filter are handed on as they are found, and of the tables written in between only three stay."""
    folder = checkpoint_dir(spark).removeprefix("file:")
    before, held = set(os.listdir(folder)), []
    docs = spark.createDataFrame([(i, "a b a c a d e f " * 9 + f"g{i % 3} h i " * 5) for i in range(30)], "doc_id bigint, text string")
    entries, suffix_tree.ENTRIES = suffix_tree.ENTRIES, 4
    try:
        tree, others, *_ = suffix_tree._train(docs.withColumn("learn", F.lit(True)), "learn", lambda part: held.append(part) or len(held))
    finally:
        suffix_tree.ENTRIES = entries
    assert tree.levels == [1, 2, 3] and tree.others == 4 and not tree.numbers
    assert all(isinstance(level, suffix_tree.Level) for level in held[:3])
    assert others.count() > 4
    assert len([f for f in set(os.listdir(folder)) - before if f.startswith("llm-")]) == 3


def test_answers_are_sums_by_row(spark, monkeypatch):
    """Whatever the pieces are, every question has the table's value or none; false ones, repeated ones and nodes count as they should."""
    monkeypatch.setattr(suffix_tree, "ASKED", 300)
    rng, width = np.random.default_rng(16), 300_001
    keys = list({(int(c), int(w)) for c, w in zip(rng.choice(rng.integers(1, width**3, 40), 500), rng.integers(-1, width, 500), strict=True)})
    table = {k: float(v) for k, v in zip(keys, rng.normal(size=len(keys)), strict=True)}
    wrong = [(c + 1, -1) for c, _ in keys[:50]] + [(c, width - 1) for c, _ in keys[50:99]]
    asks = [((keys + wrong)[i], int(r)) for i, r in zip(rng.integers(0, len(keys) + len(wrong), 4000), rng.integers(0, 90, 4000) + (7 << 33), strict=True)]
    want = Counter()
    for k, row in asks:
        if k in table:
            want[row] += table[k]
    packed = []
    for part in (asks[:1500], asks[1500:]):
        c, w, row = (np.array(x, np.int64) for x in zip(*((*k, row) for k, row in part), strict=True))
        packed += suffix_tree._packed_held([(c, w, row)], suffix_tree.SHARES * 3).to_pylist()
    asked = spark.createDataFrame([(r["part"], r["size"], r["data"]) for r in packed], "part int, size bigint, data binary")
    others = spark.createDataFrame([(*k, v) for k, v in table.items()], "c bigint, w bigint, value double")
    found = records(suffix_tree.gained(asked, others, width, 3))
    got = {r["row"]: r["gained"] for r in found}
    assert len(found) == len(got) and got.keys() == want.keys()
    assert all(abs(got[r] - v) < 1e-9 for r, v in want.items())
    assert records(suffix_tree.gained(asked.limit(0), others, width, 3)) == []


def test_lookups_and_merges_by_force():
    """Sieves let no known number slip; pairs are merged the same with and without counts, in 64 bits or beyond."""
    rng = np.random.default_rng(17)
    known = np.unique(rng.integers(0, 2**62, 3000))
    sought = rng.permutation(np.concatenate([known, known + 1, rng.integers(0, 2**62, 9000)]))
    places = {int(k): i for i, k in enumerate(known)}
    want = [places.get(int(x), -1) for x in sought]
    for found in (suffix_tree._find(known, sought), suffix_tree._find_few(known, suffix_tree._sieve(known), sought)):
        assert found.tolist() == want
    none = np.zeros(0, np.int64)
    assert suffix_tree._find_few(none, suffix_tree._sieve(none), sought).max() == -1
    for most in (50, 300_001**3):
        c, w = rng.choice(rng.integers(1, most, 40), 5000), rng.integers(0, 300_001, 30)[rng.integers(0, 30, 5000)]
        counted = sorted((*k, n) for k, n in Counter(zip(c.tolist(), w.tolist(), strict=True)).items())
        for n in (None, np.ones(5000, np.int64)):
            assert list(zip(*map(np.ndarray.tolist, suffix_tree._merged(c, w, n)), strict=True)) == counted


def test_words_of_slices():
    texts = ["x", " A\tb\x0b\x0cÉ ", None, "", "\n", "z\x1cz \x85 rare rare ", "b"]
    words = [(t or "").encode().lower().split() for t in texts]
    tree = suffix_tree.Tree({b"a": 1, b"b": 2}, np.array([1, 1, 1]), 3, 3)
    for begin in range(len(texts)):
        tokens, others, times = tree.number(pa.array(texts).slice(begin))
        for t, o, n, w in zip(tokens.to_pylist(), others.to_pylist(), times.to_pylist(), words[begin:], strict=True):
            assert np.frombuffer(t, np.int32).tolist() == [*[tree.numbers.get(x, -1) for x in w], 0]
            assert dict(zip(o, n, strict=True)) == Counter(x for x in w if x not in tree.numbers)


def test_writing_leaves_no_shuffle(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = files()
    rows = written(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10
    while files() > before and time.time() < end:
        time.sleep(0.1)
    assert files() <= before and rows.agg(F.sum("count")).first()[0] == 5000


def nearest_by_force(vectors, query, k):
    q = np.array(vectors[query], float)
    scored = sorted((-float(np.array(v, float) @ q), i) for i, v in vectors.items() if i != query)
    return [(i, -s) for s, i in scored[:k]]


def test_hostile_vectors(spark):
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=6).round(3).tolist() for i in range(60)}
    vectors |= {i: vectors[0] for i in range(100, 140)}  # copies of a query's vector
    vectors |= {i: [10 * x for x in vectors[3]] for i in (200, 201)}  # ties of large norm
    bad = [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]),
           (306, [1.0] * 5), (None, [1.0] * 6)]
    rows = [*vectors.items(), *bad, (5, vectors[5])]
    table = spark.createDataFrame([(i, v, 1, 2.0, "z") for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double, id string")
    found = {}
    single = {i: np.array(v, np.float32).astype(float) for i, v in vectors.items()}
    for r in records(neighbours.nearest(table, F.col("vec_id") % 20 == 0, 5)):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in vectors if i % 20 == 0}
    for query, rows in found.items():
        want = nearest_by_force(single, query, 5)
        assert [(r, i) for r, i, _ in sorted(rows)] == [(n, i) for n, (i, _) in enumerate(want, 1)]
        assert np.allclose([s for _, _, s in sorted(rows)], [s for _, s in want], rtol=1e-12)


def recall(table, x, every, k=20):
    hits, queries = 0, range(0, len(x), every)
    got = {q: set(part["vec_id"]) for q, part in neighbours.nearest(table, F.col("vec_id") % every == 0, k).toPandas().groupby("query_id")}
    for query in queries:
        scores = x @ x[query]
        scores[query] = -np.inf
        hits += len(set(np.argsort(-scores)[:k].tolist()) & got.get(query, set()))
    return hits / (len(queries) * k)


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").coalesce(4)


def test_recall_of_a_graph_of_many_parts(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(3000, 16)).astype(np.float32).astype(float)
    monkeypatch.setattr(neighbours, "PART_NODES", 400)
    monkeypatch.setattr(neighbours, "LEAF", 40)
    assert recall(vectors(spark, x), x, 100) >= 0.95


@pytest.mark.parametrize("scale", [1e-30, 1e30, "mixed"])
def test_recall_at_any_magnitude(spark, scale):
    """With the production values."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 24)) * (10.0 ** rng.uniform(-6, 6, size=(2500, 1)) if scale == "mixed" else scale)
    assert recall(vectors(spark, x), x, 50) >= 0.95


def test_recall_of_the_query(spark):
    """The registered query's own call on the given table."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.orderBy("vec_id").toPandas()
    assert rows["vec_id"].tolist() == list(range(len(rows)))
    assert recall(table, np.array(rows["embedding"].tolist(), float), 20) >= 0.95


def test_few_rounds_settle_the_graph(spark, monkeypatch):
    """What a round costs is a vector sent to all that a node lists, so starting lists must leave few rounds to do."""
    x = np.random.default_rng(13).normal(size=(4000, 64))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "id bigint, vec array<double>")
    rounds, ask = [], neighbours._round
    monkeypatch.setattr(neighbours, "_round", lambda *given: rounds.append(given[-1]) or ask(*given))
    graph = neighbours.build_graph(nodes.coalesce(4), 64).toPandas()
    assert len(graph) == 4000 and len(rounds) <= 2
    assert all(len(set(ids)) == neighbours.DEGREE and i not in ids for i, ids in zip(graph["id"], graph["ids"], strict=True))


def test_a_cell_of_too_many_nodes_is_cut(spark, monkeypatch):
    """Nodes of one direction fall in the same cells, whatever the centres; all have lists, and good ones."""
    monkeypatch.setattr(neighbours, "LEAF", 100)
    monkeypatch.setattr(neighbours, "CENTRES", 6)
    rng = np.random.default_rng(14)
    x = rng.normal(size=12) + 0.05 * rng.normal(size=(1500, 12))
    assert recall(vectors(spark, x), x, 50) >= 0.95


def test_few_or_no_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 0.5]), (2, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert records(neighbours.nearest(table, F.col("vec_id") == 0, 20)) == [{"query_id": 0, "rank": 1, "vec_id": 1, "score": 3.0}]
    assert neighbours.nearest(table.where("vec_id = 2"), F.lit(True), 3).count() == 0
