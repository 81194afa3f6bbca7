import duckdb
import pytest

from llm_helpers import records
from packloom.llm import mixing
from packloom.llm.catalog import MIXING_SQL


def test_equals_sql(hostile):
    docs = hostile.where("doc_id is not null").select("doc_id", "text", "source").dropDuplicates(["doc_id"])
    database = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    database.register("documents", documents)
    expected = database.execute(MIXING_SQL).fetchall()
    found = [tuple(r) for r in mixing.mix(docs).collect()]
    assert sorted(found) == sorted(expected)


@pytest.mark.parametrize("range_rows", [3, 20_000])
def test_sources_come_to_their_targets(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(mixing.plan_sources, "__defaults__", (range_rows,))
    rows = [(i, "w " * (i % 9) + ("### " * 3 if i % 4 == 0 else ""), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = records(mixing.mix(docs))
    assert found == records(mixing.mix(docs.repartition(5))) or sorted(map(str, found)) == sorted(map(str, records(mixing.mix(docs.repartition(5)))))
    names = dict((r[0], r[2]) for r in rows)
    taken, target = {}, {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"] + r["part_words"]
        taken[names[r["doc_id"]]] = taken.get(names[r["doc_id"]], 0) + r["taken"]
        target[names[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in found)) < 1e-6


def test_symbols_lower_the_weight(spark):
    rows = [(i, "word " * 9 if i % 2 else "w### " * 9, "a") for i in range(600)] + [(1000, "x " * 2400, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = [r for r in records(mixing.mix(docs, weights=(1, 3))) if r["doc_id"] < 1000]
    good, bad = (sum(r["taken"] for r in found if r["doc_id"] % 2 == odd) for odd in (1, 0))
    assert good > 1.5 * bad > 0


def test_documents_of_the_mixture(hostile):
    decided = {}
    for r in records(mixing.mix(hostile)):
        decided[r["doc_id"]] = decided.get(r["doc_id"], 0) + r["taken"]
    mixed = mixing.mixed_documents(hostile)
    assert mixed.columns == hostile.columns
    words = {}
    for r in records(mixed):
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"])])
    assert words == {i: n for i, n in decided.items() if n}


def test_empty_and_wordless_tables(spark, nothing, hostile):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    found = records(mixing.mix(hostile.where("text is null or text = ''")))
    assert found and all(r["taken"] == 0 and r["target"] == 0 for r in found)
