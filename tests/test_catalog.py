"""The registered queries against their SQL on the smallest tables, and the shape of their plans."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import check
from packloom import ScanConfig
from packloom.catalog import corpora as made
from packloom.catalog import oracles
from packloom.catalog import queries as catalog
from packloom.operators import exact
from packloom.plans.packing import Run
from packloom.sources import corpora

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


#: Merges by rank are no SQL: held against a tokenizer library instead.
WITHOUT_SQL = {"exact_tokens"}


def test_every_query_has_sql():
    assert set(catalog.queries()) - WITHOUT_SQL == set(oracles.oracles()) <= set(registered.queries())


def no_cross_join(frame):
    text = plan(frame)
    return "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - WITHOUT_SQL))
def test_query_agrees_with_sql(spark, database, name):
    frame = registered.queries()[name](spark, SF)
    assert no_cross_join(frame)
    result = database.execute(registered.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert check.rows_of(frame.columns, frame.collect()) == check.rows_of(columns, result.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() == 20


def test_row_rules_need_no_python_and_no_shuffle(spark):
    # The inputs of these are themselves shuffled: rule files per distinct project, a small table spread out.
    shuffled = ("filter_decision", "blacklist_pattern", "content_tokens")
    for name in (*shuffled, "matched_rule", "escape_path", "frame_blocks"):
        text = plan(catalog.queries()[name](spark, SF))
        assert "ArrowEvalPython" not in text and ("Exchange" not in text or name in shuffled)


def test_exact_tokens_agree_with_the_library(spark, database):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = exact.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    frame = registered.queries()["exact_tokens"](spark, SF)
    assert no_cross_join(frame)
    texts = [t for table, column in (("documents", "text"), ("pages", "html")) for (t,) in database.execute(f"SELECT {column} FROM {table}").fetchall()]
    assert sorted(r.content_tokens for r in frame.collect()) == sorted(len(library.encode_ordinary(t)) for t in texts)


def test_trees_do_not_read_texts(spark):
    run = Run(corpora.documents(spark, SF), ScanConfig(include="*.md"))
    text = plan(run.decisions.select("project", "rel_path", "is_dir", "tree_code"))
    assert "ReadSchema" in text and "text:string" not in text


def test_size_filter_reaches_the_scan(spark, tmp_path):
    table = corpora.documents(spark, SF).drop("is_binary", "lossy_utf8")
    table.write.parquet(str(tmp_path / "corpus"))
    stored = spark.read.parquet(str(tmp_path / "corpus"))
    text = plan(stored.where(F.col("length") <= 2048).select("rel_path"))
    assert "LessThanOrEqual(length,2048)" in text


def exchanged_columns(spark, frame):
    """Columns that cross an exchange of the plan, by name."""
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    found = set()
    for block in text.split("\n\n"):
        if re.match(r"\(\d+\) \w*Exchange", block.strip()):
            inputs = re.search(r"Input \[\d+\]: \[(.*)\]", block)
            found |= {c.split("#")[0] for c in inputs.group(1).split(", ")}
    return found


def test_texts_cross_the_network_for_packs_only(spark):
    entries = made.ruled_workspaces(spark, SF)
    run = Run(entries, catalog.WORKSPACE, outputs=made.first_files(entries))
    for frame in (run.decisions, run.preview(), run.stats()):
        columns = exchanged_columns(spark, frame)
        assert "content" not in columns and "text" not in columns
    assert "content" not in exchanged_columns(spark, run.survivors)
    ordered = run.pack().repartitionByRange("project", "section", "path_order")
    assert "value" in exchanged_columns(spark, ordered)


def test_a_corpus_without_ignore_files_is_not_joined(spark):
    run = Run(corpora.documents(spark, SF), ScanConfig(include="*.md"))
    assert run.marks is None and "Join" not in plan(run.survivors) and "Exchange" not in plan(run.survivors)
