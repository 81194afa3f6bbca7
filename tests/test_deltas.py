from pyspark.sql import functions as F

from helpers import values
from packloom import ScanConfig
from packloom.operators.deltas import delta_totals, token_deltas
from packloom.plans.packing import DirectoryRun, Run

SCHEMA = "project string, rel_path string, digest string, tokens bigint"
COLUMNS = ("rel_path", "from_path", "change", "tokens_before", "tokens_after", "delta")


def snapshot(spark, rows):
    return spark.createDataFrame([r if len(r) == 4 else ("p", *r) for r in rows], SCHEMA).coalesce(2)


def test_every_kind_of_change(spark):
    before = snapshot(spark, [("same", "s", 5), ("edit", "e1", 10), ("old", "m", 7), ("gone", "g", 3), ("q", "same", "x", 1)])
    after = snapshot(spark, [("same", "s", 5), ("edit", "e2", 4), ("new", "m", 7), ("extra", "n", 2), ("q", "other", "m", 7), ("q", "same", "x", 1)])
    deltas = token_deltas(before, after)
    assert values(deltas.where("project = 'p'"), *COLUMNS) == {
        ("edit", None, "changed", 10, 4, -6), ("new", "old", "moved", 7, 7, 0), ("gone", None, "removed", 3, None, -3),
        ("extra", None, "added", None, 2, 2)}
    # Contents are matched within a project.
    assert values(deltas.where("project = 'q'"), *COLUMNS) == {("other", None, "added", None, 7, 7)}
    totals = values(delta_totals(deltas), "project", "change", "files", "delta")
    assert ("p", None, 4, -7) in totals and ("p", "moved", 1, 0) in totals and ("q", None, 1, 7) in totals


def test_copies_are_matched_one_by_one(spark):
    """A content that most files share: as many moves as files went and came, the rest added or removed."""
    before = snapshot(spark, [(f"a/{i:04}", "copy", 1) for i in range(900)] + [("a/own", "own", 9)])
    after = snapshot(spark, [(f"b/{i:04}", "copy", 1) for i in range(700)] + [("b/own", "own", 9), ("a/0000", "copy", 1)])
    deltas = token_deltas(before, after)
    assert values(deltas.groupBy("change").count(), "change", "count") == {("moved", 701), ("removed", 199)}
    moved = {r.from_path: r.rel_path for r in deltas.where("change = 'moved'").collect()}
    assert moved["a/own"] == "b/own" and all(moved[f"a/{i + 1:04}"] == f"b/{i:04}" for i in range(700))


def test_nothing_before_or_after(spark):
    empty, some = snapshot(spark, [("x", "y", "z", 0)]).limit(0), snapshot(spark, [("a", "d", 4)])
    assert values(token_deltas(empty, some), "rel_path", "change", "delta") == {("a", "added", 4)}
    assert values(token_deltas(some, empty), "rel_path", "change", "delta") == {("a", "removed", -4)}
    assert token_deltas(empty, empty).count() == 0 and token_deltas(some, some).count() == 0


def test_snapshots_of_runs(spark, entries, tmp_path):
    files = {"a.txt": "one two", "b.txt": "three", "c.md": "no"}
    root = tmp_path / "p"
    root.mkdir()
    for name, text in files.items():
        (root / name).write_text(text)
    config = ScanConfig(include="*.txt")
    of_table, of_directory = Run(entries(files), config).snapshot(), DirectoryRun(spark, [str(root)], config).snapshot()
    assert values(of_table, *of_table.columns) == values(of_directory, *of_table.columns)
    assert of_table.count() == 2 and token_deltas(of_table, of_directory).count() == 0
    assert values(of_table.where("rel_path = 'b.txt'"), "digest") == {spark.range(1).select(F.sha2(F.lit("three"), 256)).first()[0]}
