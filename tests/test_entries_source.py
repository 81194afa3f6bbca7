import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import values
from packloom import ScanConfig
from packloom.operators.ignore import ignore_files, ignored_entries
from packloom.plans.packing import DirectoryRun
from packloom.sources.directory import read_entries
from packloom.sources.entries_source import FORMAT, FilteredReader, scan_entries

COLUMNS = ("project", "rel_path", "is_dir", "is_file", "length", "link_target", "read_error")


def make_tree(root, seed=0):
    """Directories with ignore files at several depths, inner repositories, links and odd names."""
    rng = random.Random(seed)
    lines = ["build/", "/top", "*.log", "!keep.log", "a/b", "**/gen", "gen/**", "!/a/gen/", "x*", "[", "\\#odd", "c/", "!c/", "d?"]
    for _ in range(60):
        path = root.joinpath(*[rng.choice(["a", "b", "c", "build", "gen", "top", "x1", "d1", "#odd", "sub", ".hidden"]) for _ in range(rng.randint(1, 4))])
        path.mkdir(parents=True, exist_ok=True)
        (path / rng.choice(["f.txt", "k.log", "keep.log"])).write_text("t")
        if rng.random() < 0.25:
            name = rng.choice([".gitignore", ".ignore"])
            (path / name).write_text("\n".join(rng.sample(lines, 3)))
        if rng.random() < 0.06:
            (path / ".git" / "info").mkdir(parents=True, exist_ok=True)
            (path / ".git" / "info" / "exclude").write_text("sub/\n")
    (root / ".gitignore").write_text("build/\n!a/build/\n")
    (root / "link").symlink_to(root / "a")


def tree_of(tmp_path, seed, name="proj"):
    root = tmp_path / name
    root.mkdir()
    make_tree(root, seed)
    return str(root)


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_lists_what_the_level_by_level_listing_lists(spark, tmp_path, partitions):
    roots = [tree_of(tmp_path, 1), tree_of(tmp_path, 2, "other")]
    found = scan_entries(spark, roots, partitions=partitions)
    assert found.count() == found.select("project", "rel_path").distinct().count()
    assert values(found, *COLUMNS) == values(read_entries(spark, roots), *COLUMNS)
    assert found.rdd.getNumPartitions() == partitions


@pytest.mark.parametrize("seed", range(3))
def test_pruned_listing_keeps_what_is_not_ignored(spark, tmp_path, seed):
    root = tree_of(tmp_path, seed)
    whole, pruned = read_entries(spark, [root]), scan_entries(spark, [root], prune=True, partitions=3)
    texts = whole.where("is_file").withColumn("content", F.lit(None).cast("string")).collect()
    contents = [(r.rel_path, open(r.location, "rb").read().decode()) for r in texts if r.link_target is None]
    files = whole.join(spark.createDataFrame(contents, "rel_path string, content string"), "rel_path", "left")
    ignored = values(ignored_entries(whole, ignore_files(files)), "rel_path")
    everything, listed = values(whole, "rel_path"), values(pruned, "rel_path")
    # Exactly what lies below an ignored directory is missing.
    below = {p for p in everything if any("/".join(p.split("/")[:k]) in ignored for k in range(1, len(p.split("/"))))}
    assert everything - listed == below and below


def test_pruned_directories_are_never_listed(spark, tmp_path, monkeypatch):
    root = tree_of(tmp_path, 5)
    opened = []
    import packloom.sources.entries_source as module

    plain = module.children_of
    monkeypatch.setattr(module, "children_of", lambda d: opened.append(d["location"]) or plain(d))

    def listings(prune, **filters):
        opened.clear()
        reader = FilteredReader([root], prune, 4)
        list(reader.pushFilters(filters.get("pushed", [])))
        rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
        return len(set(opened)), {r["rel_path"] for r in rows}

    from pyspark.sql.datasource import EqualTo, StringStartsWith

    whole, paths = listings(False)
    fewer, _ = listings(True)
    assert fewer < whole
    some, found = listings(False, pushed=[StringStartsWith(("rel_path",), "a/b")])
    assert some < whole and {p for p in paths if p.startswith("a/b")} <= found
    assert listings(False, pushed=[EqualTo(("project",), "another")]) == (0, set())


def test_filters_are_pushed_down(spark, tmp_path):
    roots = [tree_of(tmp_path, 1), tree_of(tmp_path, 2, "other")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = scan_entries(spark, roots)
        expected = {(p, path) for p, path in values(read_entries(spark, roots), "project", "rel_path") if p == "other" and path.startswith("a")}
        assert values(found.where("project = 'other' and rel_path like 'a%'"), "project", "rel_path") == expected
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_roots_must_be_directories(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(Exception, match="Scan path must be a directory"):
        scan_entries(spark, [str(tmp_path / "file")])
    with pytest.raises(Exception, match="Scan path must be a directory"):
        spark.read.format(FORMAT).option("roots", json.dumps([str(tmp_path / "file")])).load().count()
    assert scan_entries(spark, []).count() == 0


def test_a_pruned_run_packs_the_same(spark, tmp_path):
    root = tree_of(tmp_path, 7)
    plain, pruned = DirectoryRun(spark, [root], ScanConfig()), DirectoryRun(spark, [root], ScanConfig(), prune=True)
    assert values(pruned.pack(), "section", "path_order", "value") == values(plain.pack(), "section", "path_order", "value")
    assert values(pruned.stats(), "files_processed", "output_tokens") == values(plain.stats(), "files_processed", "output_tokens")
