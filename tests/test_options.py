"""Options that are safe to run on: states of profile files, outputs, links, previews."""

import pytest
from helpers import values

from packloom import ScanConfig
from packloom.fixed_values import PROFILE_FILE
from packloom.operators import profiles
from packloom.plans.packing import DirectoryRun, Run

FIELDS = "project string, include string, exclude string, tree_include string, tree_exclude string, max_size bigint, " \
    "no_ignore boolean, tree_no_ignore boolean, no_tree boolean, no_blacklist boolean, config_status string"


def options(spark, *rows):
    return spark.createDataFrame([(p, None, exclude, None, None, 500, False, False, False, False, status) for p, exclude, status in rows], FIELDS)


def test_no_project_vanishes_and_none_with_bad_options_is_packed(spark, entries):
    files = entries({"keep.txt": "k", "secret/x.txt": "s"}, "ok")
    for project in ("none", "legacy", "twice", "glob"):
        files = files.unionByName(entries({"keep.txt": "k", "secret/x.txt": "s"}, project))
    run = Run(files, options(
        spark, ("ok", "secret/", "ok"), ("legacy", "secret/", "legacy"), ("twice", None, "ok"), ("twice", "secret/", "ok"),
        ("glob", "a[", "ok"), ("unseen", None, "invalid")))
    included = values(run.decisions.where("content_code = 'included'"), "project", "rel_path")
    assert included == {("ok", "keep.txt"), ("none", "keep.txt"), ("none", "secret/x.txt")}
    errors = {r.project: r.config_error for r in run.config_errors().collect()}
    assert set(errors) == {"legacy", "twice", "glob", "unseen"} and errors["legacy"] == "legacy" and errors["unseen"] == "invalid"
    assert values(run.stats(), "project") == {"ok", "none"}


@pytest.mark.parametrize("text, requested, status", [
    ("{ bad json", None, "invalid"), (None, "wide", "file_not_found"), ('{"profiles":{}}', "wide", "profile_not_found"), ("{ bad json", "wide", "ok")])
def test_profile_states_reach_the_run(spark, entries, text, requested, status):
    files = entries({"a.txt": "a", **({PROFILE_FILE: text} if text else {})})
    found = profiles.profile_files(files)
    skips = status == "ok"
    asked = spark.createDataFrame([("p", requested, skips)], "project string, requested string, no_config boolean")
    resolved = profiles.resolve_configs(asked, profiles.parse_profiles(found), profiles.classify_configs(found))
    run = Run(files, resolved)
    assert (run.decisions.count() > 0) == skips
    assert values(run.config_errors(), "project", "config_error") == (set() if skips else {("p", status)})


def test_another_tools_files(spark, entries):
    files = entries({".otherrc": '{"profiles":{"default":{"include":"*.md"}}}', "p.other": "old", "a.txt": "", "a.md": ""})
    found = profiles.profile_files(files, ".otherrc")
    assert found.count() == 1
    asked = spark.createDataFrame([("p", None)], "project string, requested string")
    resolved = profiles.resolve_configs(asked, profiles.parse_profiles(found), pack_suffix=".other")
    assert values(resolved, "output_path", "include") == {("p.other", "*.md")}
    run = Run(files, ScanConfig(blacklist=(".otherrc", "*.other")))
    assert values(run.decisions.where("content_code = 'blacklist'"), "rel_path", "content_rule") == {(".otherrc", ".otherrc"), ("p.other", "*.other")}


def test_named_outputs_are_left_out(spark, entries):
    files = entries({"out.txt": "old", "elsewhere/out.txt": "mine", "a.txt": "a"})
    for path, hidden in (("out.txt", {"out.txt"}), ("./x/../out.txt", {"out.txt"}), ("/elsewhere/out.txt", set()), ("..", set())):
        resolved = options(spark, ("p", None, "ok")).selectExpr("*", f"'{path}' as output_path")
        assert values(Run(files, resolved).decisions.where("content_code = 'current_output'"), "rel_path") == hidden


def test_links_in_directories(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src" / "deep").mkdir(parents=True)
    (root / "src" / "m.rs").write_text("m")
    (root / "src" / "deep" / "n.rs").write_text("n")
    (root / "real.txt").write_text("old pack")
    (root / "out.txt").symlink_to(root / "real.txt")
    (root / "other.txt").symlink_to(root / "real.txt")
    (root / "ln").symlink_to(root / "src")
    (root / "src" / "up").symlink_to(root / "src" / "deep")
    (root / "away").symlink_to(tmp_path)
    (tmp_path / "secret.txt").write_text("s")
    outputs = spark.createDataFrame([("proj", "out.txt")], "project string, rel_path string")
    run = DirectoryRun(spark, [str(root)], ScanConfig(exclude="src/deep/"), outputs)
    decided = {r.rel_path: r.content_code for r in run.decisions.collect()}
    assert {p for p, c in decided.items() if c == "current_output"} == {"out.txt", "real.txt", "other.txt"}
    asked = ["ln/m.rs", "ln/up/n.rs", "src/m.rs", "ln", "ln/none.rs", "away/secret.txt", "nope/../src/m.rs", "src/m.rs/.", "src/deep/../m.rs", ".",
             f"{root}/src/./m.rs"]
    requests = spark.createDataFrame([("proj", p) for p in asked], "project string, path string")
    roots = spark.createDataFrame([("proj", str(root))], "project string, root string")
    answers = {r.path: r.content_code for r in run.explain(requests, roots).collect()}
    assert answers == {
        "ln/m.rs": "included", "ln/up/n.rs": "exclude", "src/m.rs": "included", "ln": "not_a_file", "ln/none.rs": "not_found",
        "away/secret.txt": "outside_root", "nope/../src/m.rs": "not_found", "src/m.rs/.": "not_found", "src/deep/../m.rs": "included",
        ".": "not_a_file", f"{root}/src/./m.rs": "included"}


def test_the_root_is_never_ignored(spark, entries):
    run = Run(entries({".gitignore": "*\n!keep.txt\n", "keep.txt": "", "x.txt": ""}), ScanConfig())
    requests = spark.createDataFrame([("p", p) for p in (".", "keep.txt", "x.txt")], "project string, path string")
    answers = {r.path: (r.content_code, r.tree_code) for r in run.explain(requests).collect()}
    assert answers == {".": ("not_a_file", "included"), "keep.txt": ("included", "included"), "x.txt": ("ignore", "ignore")}


def test_previews_name_every_skipped_file(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "big.txt").write_text("x" * 2000)
    (root / "zero.txt").write_bytes(b"a\0b")
    (root / "ok.txt").write_text("ok")
    (root / "ln").symlink_to(root / "src")
    run = DirectoryRun(spark, [str(root)], ScanConfig(max_size=1))
    skipped = run.preview().where("status_line like '[SKIP]%'")
    assert values(skipped, "rel_path") == {"big.txt", "zero.txt", "ln"}
    assert run.stats().first().files_skipped == 3


def test_names_claimed_twice_are_refused(spark):
    existing = spark.createDataFrame([("p", "default"), ("p", "old"), ("q", "default")], "project string, name string").selectExpr(
        "*", *[f"cast(null as {kind}) as {name}" for name, kind in profiles.FIELDS.items()])
    edits = spark.createDataFrame([
        ("p", "create", "moved", None), ("p", "rename", "default", "moved"), ("p", "update", "old", None),
        ("q", "rename", "default", "moved")], "project string, op string, name string, new_name string").selectExpr(
        "*", *[f"cast(null as {kind}) as {name}" for name, kind in profiles.FIELDS.items()])
    status = {(r.project, r.op): r.status for r in profiles.edit_profiles(existing, edits).collect()}
    assert status == {("p", "create"): "claimed_twice", ("p", "rename"): "claimed_twice", ("p", "update"): "ok", ("q", "rename"): "ok"}
    after = values(profiles.apply_edits(existing, edits), "project", "name")
    assert after == {("p", "default"), ("p", "old"), ("q", "moved")}


def test_directories_that_fail_during_the_walk_count(spark, tmp_path):
    """A directory that is there when its parent is listed, and cannot be listed itself any more."""
    import pyarrow as pa

    from packloom.sources import directory

    (tmp_path / "gone.txt").write_text("x")
    batch = pa.RecordBatch.from_pylist([
        {"project": "p", "root": str(tmp_path), "location": str(tmp_path / "vanished").encode()},
        {"project": "p", "root": str(tmp_path), "location": str(tmp_path).encode()}])
    rows = [r for b in directory._list_directories(iter([batch])) for r in b.to_pylist()]
    assert [(r["rel_path"], r["location"] is None) for r in rows] == [("vanished", True), ("gone.txt", False)]
    listed = spark.createDataFrame(
        [("p", "vanished", True, False, None, None, "/r", None, b"v"), ("p", "a", False, True, 1, None, "/r", None, b"a"),
         ("p", "vanished", True, False, None, None, "/r", "list: gone (os error 2)", None),
         ("q", "", True, False, None, None, "/q", "list: gone (os error 2)", None)], directory.ENTRY)
    found = values(directory.with_failures(listed), "project", "rel_path", "read_error")
    assert found == {("p", "vanished", "list: gone (os error 2)"), ("p", "a", None), ("q", "", "list: gone (os error 2)")}
