import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from llm_helpers import records


@pytest.fixture(scope="module")
def folder(spark, hostile, no_labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    hostile.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(24)], no_labels.schema).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_returns_documents(spark, hostile, nothing, folder, empty):
    docs = nothing if empty else hostile
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns and (kept.count() == 0) == empty


def test_stages_drop_what_they_should(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for stage, label, bad in ((corpus_pipeline.quality_stage, "quality", 0), (corpus_pipeline.toxicity_stage, "toxic", 1)):
        kept = stage(spark, docs, sf).join(labels, "doc_id")
        all_bad, all_good = (labels.where(c).count() for c in (F.col(label) == bad, F.col(label) != bad))
        assert kept.where(F.col(label) == bad).count() < 0.4 * all_bad and kept.where(F.col(label) != bad).count() >= 0.98 * all_good


@pytest.mark.parametrize("given", [[], [(i, 1, 1) for i in range(24)], [(i, 1, i % 2) for i in range(1000, 1100)]])
def test_toxicity_without_usable_labels_drops_nothing(spark, hostile, no_labels, tmp_path, given):
    spark.createDataFrame(given, no_labels.schema).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.toxicity_stage(spark, hostile, str(tmp_path)).count() == hostile.count()


def test_one_of_each_group_stays(spark, hostile):
    kept = records(corpus_pipeline.near_duplicate_stage(spark, hostile, ""))
    ids = [r["doc_id"] for r in kept]
    assert 15 in ids and not {16, 17, 18, 19, 7, 8} & set(ids) and 6 in ids and ids.count(None) == 2


def test_one_row_of_each_group_stays(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(1, a), (1, a), (1, a), (2, a), (None, a), (None, b), (None, b + " end"), (3, c), (4, c), (4, d), (5, e), (None, e), (6, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted(((r["doc_id"], (r["text"] or " ")[0]) for r in records(corpus_pipeline.near_duplicate_stage(spark, docs, ""))), key=str)
    assert kept == sorted([(1, "a"), (None, "b"), (3, "c"), (4, "d"), (5, "e"), (6, " "), (7, " ")], key=str)


def test_runs_whole(spark, folder):
    found = records(corpus_pipeline.run(spark, folder))
    assert found and all(r["length"] <= 2048 for r in found)
