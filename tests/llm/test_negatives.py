import math
import random

import numpy as np
from pyspark.sql import functions as F

from packloom.llm import catalog, negatives


def brute(rows, every=50):
    """All scores in whole numbers of any size."""
    valid = []
    for number, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(256 * x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        valid.append((number, vec_id, [math.floor(256 * x) for x in vector], label))
    out = []
    for a, a_id, a_vector, a_label in valid:
        if a_id is None or a_id % every:
            continue
        scored = [(sum(x * y for x, y in zip(a_vector, v, strict=False)), i, n, lab) for n, i, v, lab in valid if n != a]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0, s[2]))
        for p_score, p_id, _, _ in [s for s in scored if s[3] == a_label][:5]:
            window = [s for s in scored if s[3] != a_label and 50 * p_score <= 100 * s[0] <= 95 * p_score]
            out += [(a_id, p_id, rank, s[1], p_score, s[0]) for rank, s in enumerate(window[:3], 1)]
    return out


def mined(spark, folder, rows):
    path = str(folder / f"t{random.random()}")
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return [tuple(r) for r in catalog.op12_hard_negatives(spark, path).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def in_order(rows):
    return sorted(rows, key=str)


def clusters(rng, count, width=12):
    centers = rng.normal(size=(10, width)) + 0.7
    return [(i, (centers[i % 10] + rng.normal(size=width) * 0.8).tolist(), i % 10) for i in range(count)]


def test_equals_brute_force(spark, tmp_path):
    rows = clusters(np.random.default_rng(1), 1500)
    want = brute(rows)
    assert len(want) > 100
    assert in_order(mined(spark, tmp_path, rows)) == in_order(want)


def test_blocks_anchor_groups_and_depths_do_not_matter(spark, tmp_path, monkeypatch):
    rows = clusters(np.random.default_rng(2), 400)
    for name, value in (("BLOCK_ROWS", 37), ("ANCHOR_BYTES", 700), ("FIRST_DEPTH", 2)):
        monkeypatch.setattr(negatives, name, value)
    assert in_order(mined(spark, tmp_path, rows)) == in_order(brute(rows))


def test_ties_copies_and_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = clusters(rng, 100, 4)
    # One vector holds much of the table, in two labels, and rows repeat, anchors too.
    rows += [(200 + i, [1.0, 2.0, 0.5, -1.0], i % 2) for i in range(150)] + rows[:60]
    assert in_order(mined(spark, tmp_path, rows)) == in_order(brute(rows))


def test_hostile_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = clusters(rng, 120, 3) + [
        (150, None, 1), (200, [1.0, None, 2.0], 1), (250, [float("nan"), 1.0, 1.0], 1), (300, [float("inf"), 0.0, 0.0], 2),
        (350, [1.0, 2.0, 3.0], None), (400, [], 3), (450, [0.0, 0.0, 0.0], 4), (None, [1.0, 1.0, 1.0], 1), (None, [2.0, 2.0, 2.0], 0),
        (-50, [1.0, 0.5], 5), (500, [1e-9, -1e-9, 0.001], 6)]
    want = brute(rows)
    assert in_order(mined(spark, tmp_path, rows)) == in_order(want)
    assert {r[0] for r in want} & {0, 50, 100}
    assert mined(spark, tmp_path, []) == []
    assert mined(spark, tmp_path, [(50, [1.0], 1)]) == []


def test_large_components_are_exact(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(2**18, 2**19, 4) + rng.integers(0, 2**8, 4) / 256).tolist(), i % 3) for i in range(120)]
    want = brute(rows)
    assert max(r[4] for r in want) > 2**53
    assert in_order(mined(spark, tmp_path, rows)) == in_order(want)
    # Beyond long: no failure, and scores end where long ends.
    huge = [(i, [1e150, float(i)], i % 2) for i in range(100)] + [(1000, [1e308, 1.0], 1)]
    assert all(abs(r[4]) < 2**63 for r in mined(spark, tmp_path, huge))


def test_reading_stops_early():
    """The threshold settles a search before every row is read, where a few rows stand out."""
    rows = [{"row": i, "vec_id": i, "label": i % 2, "vector": [float(1000 if i < 20 else i % 50), float(900 if i < 20 else i % 40)]} for i in range(2000)]
    block = negatives.Block(rows)
    wanted = negatives.Wanted(5)
    read = 0
    for new, scores, threshold in block.reader(np.array([3.0, 2.0])):
        wanted.offer(block, new, scores)
        read += len(new)
        if wanted.settled(threshold):
            break
    assert read < 500 and wanted.keys[:, 1].tolist() == [0, 1, 2, 3, 4]


def test_extra_columns_are_ignored(spark, tmp_path):
    rows = clusters(np.random.default_rng(6), 200, 5)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns(
        {"row": F.lit("x"), "score": F.lit(1), "vector": F.lit(2), "rank": F.lit(3), "windows": F.lit(4)})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(negatives.integer_vectors(frame, label), F.col("vec_id") % 50 == 0)
    assert in_order(tuple(r) for r in got.collect()) == in_order(brute(rows))
