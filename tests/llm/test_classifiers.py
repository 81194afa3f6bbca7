import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import records
from packloom.llm import catalog, language, quality, toxicity
from packloom.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, least", [("op4_toxicity", "toxic", 0.93), ("op10_quality_classifier", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = catalog.queries()[name](spark, SF)
    assert found.count() == 1000 and found.where("score < 0 or score > 1 or score is null or predicted <> int(score >= 0.5)").count() == 0
    right, n = found.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert n > 50 and right >= least


def test_held_out_languages(spark):
    found = catalog.op3_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    joined = found.where("held_out").join(docs, "doc_id")
    assert joined.where("lang_pred = lang").count() >= 0.97 * joined.count()
    assert found.where("score < 0 or score > 1").count() == 0 and found.where("rejected").count() > 0


def test_fits_do_not_see_what_is_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = ~held_out("doc_id", 3, 1)
    turned = labels.withColumn("quality", F.when(learn, F.col("quality")).otherwise(1 - F.col("quality")))
    assert quality.train_quality(docs, labels, learn=learn) == quality.train_quality(docs, turned, learn=learn)


def test_bound_counts_only_labels_of_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)], "doc_id bigint, quality int, toxic int")
    assert {r["doc_id"] for r in records(quality.sample_labelled(docs, labels, "quality", None, 40))} == set(range(30))
    assert quality.sample_labelled(docs, labels, "quality", F.col("doc_id") < 20, 10).count() == 10


def test_rules_say_what_the_expression_computes(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["ab", "c|d", "E!", "ff."], rng.integers(1, 40))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(t.count("|") > 3)) for i, t in enumerate(texts)], "doc_id bigint, quality int")
    model = quality.train_quality(docs, labels)
    assert model.rules
    rows = docs.select("doc_id", model.score(F.col("text")).alias("s"), *[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).toPandas()
    values = {n: rows[n].to_numpy(float) for n in quality.STATISTICS}
    logit = model.bias + sum(r.weight * r.holds(values) for r in model.rules)
    assert np.allclose(rows["s"], 1 / (1 + np.exp(-logit)))


def test_sparse_weights_drop_useless_columns():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 12)).astype(float)
    _, w = quality._sparse_weights(x, x[:, 3], 0.01)
    assert w[3] > 1 and (np.abs(np.delete(w, 3)) < 0.05).all()


def test_features_are_words_pairs_and_skips():
    docs, hashes = toxicity.features(["You are, AWFUL", "awful", None, "a b", ""])
    alone = toxicity.features(["awful"])[1][0]
    assert np.bincount(docs, minlength=5).tolist() == [6, 1, 0, 3, 0] and (hashes == alone).sum() == 2


def test_every_feature_of_enough_documents_is_a_coordinate(spark):
    each = 2000
    texts = [" ".join(f"w{at}x{i}" for i in range(each)) for at in range(25) for _ in range(toxicity.LEAST_DOCS)]
    sample = spark.createDataFrame([(t,) for t in texts], "text string")
    found = toxicity._coordinates(sample)
    assert len(found) == 25 * (3 * each - 3) > 1 << 17 and (np.diff(found.astype(float)) >= 0).all()


def test_ftrl_drops_noise():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(3000):
        label = int(rng.random() < 0.3)
        rows.append(([0, *([1] if label else []), *(2 + rng.choice(50, 5, replace=False))], label))
    z, n = np.zeros(52), np.zeros(52)
    toxicity._learn(rows, z, n)
    w = toxicity._weights(z, n)
    assert w[1] > 3 and w[0] < 0 and np.abs(w[2:]).max() < 1


def test_hostile_tables(spark, hostile, nothing, no_labels):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(24)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], no_labels.schema)
    out = held_out("doc_id", 3, 1)
    for given in (labels, no_labels, labels.where("quality = 1")):
        for docs in (hostile, nothing):
            for found in (
                    quality.score_quality(docs, quality.train_quality(docs, given), out),
                    toxicity.score_toxicity(docs, toxicity.train_ftrl(docs, given), out)):
                rows = records(found)
                assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)


def test_language_of_hostile_texts(hostile, nothing):
    found = records(language.identify(hostile, language.train_languages(hostile, F.lit(True)), held_out("doc_id", 4, 2)))
    texts = {r["doc_id"]: r["text"] for r in records(hostile) if r["doc_id"] is not None}
    assert len(found) == hostile.count()
    for r in found:
        if r["doc_id"] is not None:
            has_letter = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert r["lang_pred"] in ("en", "fr") if has_letter else (r["lang_pred"], r["score"]) == ("und", 0.0)
    empty = language.train_languages(nothing, F.lit(True))
    assert empty == {} and {r["lang_pred"] for r in records(language.identify(hostile, empty, F.lit(False)))} == {"und"}
    one = language.identify(hostile, language.train_languages(hostile, F.col("lang") == "en"), F.lit(False))
    assert {r["lang_pred"] for r in records(one)} == {"en", "und"}


def test_every_language_is_learned(spark, monkeypatch):
    names = [f"l{i:03}" for i in range(520)]
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(4 * len(names))]
    text = lambda at: " ".join(stems[4 * at + j] for j in (0, 1, 2, 3, 1, 0, 3, 2))
    rows = [(3 * at + j, text(at), name) for at, name in enumerate(names) for j in range(1 if at >= 500 else 2)]
    docs = spark.createDataFrame([*rows, (9999, None, None)], "doc_id bigint, text string, lang string")
    dictionaries = language.train_languages(docs, F.lit(True))
    assert sorted(dictionaries) == names
    texts = [text(at) for at in (0, 499, 500, 519)] + [None, "12"]
    whole = language.Judge(dictionaries).all(texts)
    assert [w[0] for w in whole] == ["l000", "l499", "l500", "l519", "und", "und"]
    monkeypatch.setattr(language, "GROUP", 7)
    monkeypatch.setattr(language, "SIZES", 600)
    assert language.Judge(dictionaries).all(texts) == whole
