import pytest
from helpers import values
from pyspark.sql import functions as F

from packloom import ScanConfig
from packloom.fixed_values import PACK_SUFFIX, PROFILE_FILE
from packloom.functions.content import decode_lossy, is_binary_bytes, is_lossy
from packloom.functions.globs import GlobError
from packloom.operators.decide import judge, with_facts
from packloom.operators.explain import report
from packloom.operators.render import included
from packloom.plans.packing import Run
from packloom.sources.content import inspect_bytes


def decided(entries, files, side="content", run=None, **options):
    run = run or Run(entries(files), ScanConfig(**options))
    rows = run.decisions.select("rel_path", f"{side}_code", f"{side}_rule").collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def test_sensitive_names_are_blocked_in_any_case(entries):
    files = {"config/.ENV.PRODUCTION": "", "keys/DEPLOY.PEM": "", f"{PACK_SUFFIX}-tmp-123": "", "ok.txt": "",
             "a/.env.d/x.txt": "", ".env.d/x.txt": "", "NODE_modules/x": "", PROFILE_FILE: "", ".ds_store": ""}
    got = decided(entries, files)
    assert got["config/.ENV.PRODUCTION"] == ("blacklist", ".env.*")
    assert got["keys/DEPLOY.PEM"] == ("blacklist", "*.pem")
    assert got[f"{PACK_SUFFIX}-tmp-123"] == ("blacklist", f"{PACK_SUFFIX}-tmp-*")
    assert got["a/.env.d/x.txt"] == ("included", None)
    assert got[".env.d/x.txt"] == ("blacklist", ".env.*")
    assert got["NODE_modules/x"] == ("blacklist", "node_modules")
    assert got[PROFILE_FILE] == ("blacklist", PROFILE_FILE)
    assert got[".ds_store"] == ("blacklist", ".DS_Store")
    assert got["ok.txt"] == ("included", None)


def test_blacklist_can_be_switched_off(entries):
    name = f"context{PACK_SUFFIX}"
    assert decided(entries, {name: "", ".env": ""}) == {
        name: ("blacklist", f"*{PACK_SUFFIX}"), ".env": ("blacklist", ".env")}
    assert set(decided(entries, {name: "", ".env": ""}, no_blacklist=True).values()) == {("included", None)}


def test_exclude_beats_include(entries):
    got = decided(entries, {"main.rs": "", "lib.rs": "", "x.md": ""}, include="*.rs, *.toml", exclude="main.rs")
    assert got == {"main.rs": ("exclude", "main.rs"), "lib.rs": ("included", None), "x.md": ("include", "*.rs,*.toml")}


def test_anchored_and_simple_patterns(entries):
    files = {"main.rs": "", "src/main.rs": "", "a/src/x": "", "tests/t": "", "a/tests/t": ""}
    assert [p for p, d in sorted(decided(entries, files, exclude="main.rs").items()) if d[0] == "exclude"] == ["main.rs"]
    got = decided(entries, files, exclude="src,tests/")
    assert {p for p, d in got.items() if d[0] == "exclude"} == {"src", "src/main.rs", "a/src", "a/src/x", "tests/t"}


def test_content_and_tree_rules_are_independent(entries):
    files = {"Cargo.toml": "", "main.rs": ""}
    options = dict(include="*.rs", tree_include="*.toml")
    assert decided(entries, files, **options)["Cargo.toml"] == ("include", "*.rs")
    assert decided(entries, files, "tree", **options)["Cargo.toml"] == ("included", None)
    assert decided(entries, files, "tree", include="*.rs")["Cargo.toml"] == ("include", "*.rs")
    assert decided(entries, files, "tree", include="*.rs", tree_include="")["Cargo.toml"] == ("included", None)


@pytest.mark.parametrize("base, override, ignored", [
    (False, None, True), (True, None, False), (True, False, True), (False, True, False)])
def test_tree_ignore_setting_is_inherited(entries, base, override, ignored):
    got = decided(entries, {".gitignore": "x.txt", "x.txt": ""}, "tree", no_ignore=base, tree_no_ignore=override)
    assert got["x.txt"] == (("ignore", None) if ignored else ("included", None))


def test_ignore_comes_before_include(entries):
    files = {".gitignore": "ignored.txt\n", "ignored.txt": ""}
    assert decided(entries, files, include="*.rs")["ignored.txt"] == ("ignore", None)
    assert decided(entries, files, no_ignore=True)["ignored.txt"] == ("included", None)
    assert decided(entries, files, no_ignore=True, include="*.rs")["ignored.txt"] == ("include", "*.rs")


def test_size_limit_is_exact(entries):
    files = {"exact.txt": "x" * 1024, "over.txt": "x" * 1025, "empty.txt": ""}
    got = decided(entries, files, max_size=1)
    assert got == {"exact.txt": ("included", None), "empty.txt": ("included", None),
                   "over.txt": ("max_size", "max-size = 1 KiB, actual = 1025 bytes")}
    assert decided(entries, files, max_size=2**63 - 1)["over.txt"] == ("included", None)


def test_bytes(spark):
    raw = [("late.dat", bytearray(b"x" * 1500 + b"\0" + b"x" * 547)), ("legacy.txt", bytearray(b"\xffa")),
           ("good.txt", bytearray("é".encode())), ("empty.txt", bytearray(b"")), ("gone.txt", None)]
    rows = spark.createDataFrame(raw, "rel_path string, content_bytes binary").selectExpr(
        "'p' as project", "*", "cast(octet_length(content_bytes) as bigint) as length",
        "if(content_bytes is null, 'read: Permission denied (os error 13)', null) as read_error")
    got = judge(with_facts(inspect_bytes(rows)), ScanConfig().rules())
    assert values(got, "rel_path", "content_code") == {
        ("late.dat", "binary"), ("legacy.txt", "included_lossy"), ("good.txt", "included"),
        ("empty.txt", "included"), ("gone.txt", "unreadable")}
    assert got.where("rel_path = 'legacy.txt'").first().content == "�a"
    assert got.where("rel_path = 'gone.txt'").first().content_rule == "read: Permission denied (os error 13)"


def test_malformed_utf8_matches_replacement_decoding(spark):
    cases = [b"\xff", b"a\xc3", b"\xe2\x82", b"\xf0\x9f\x98x", b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\x80\x80a", b"ok"]
    rows = spark.createDataFrame([(bytearray(c),) for c in cases], "b binary")
    got = rows.select("b", decode_lossy(F.col("b")), is_lossy(F.col("b")), is_binary_bytes(F.col("b"))).collect()
    for case, text, lossy, binary in got:
        assert text == bytes(case).decode("utf-8", "replace")
        assert lossy == (text != bytes(case).decode("utf-8", "ignore")) and not binary


def explained(run, spark, *paths, roots=None):
    rows = report(run.explain(spark.createDataFrame([("p", p) for p in paths], "project string, path string"), roots))
    return {r.path: (r.content_result, r.content_rule, r.tree_result, r.tree_rule) for r in rows.collect()}


def test_explain(spark, entries):
    files = {"src/main.rs": "fn", ".env": "", "dir/": "", f"out{PACK_SUFFIX}": "old", ".gitignore": "build/\n", "build/x": "", "big.txt": "x" * 2000}
    outputs = spark.createDataFrame([("p", f"out{PACK_SUFFIX}")], "project string, rel_path string")
    run = Run(entries(files), ScanConfig(max_size=1), outputs=outputs)
    got = explained(run, spark, "src/main.rs", "./src//../src/main.rs", "missing.rs", ".env", "dir", "src", ".",
                    f"out{PACK_SUFFIX}", "../other", "build/x", "build", "big.txt", "/abs/x")
    included_, directory = ("included", None), "not a content file (directory or special path)"
    assert got["src/main.rs"] == got["./src//../src/main.rs"] == included_ * 2
    assert got["missing.rs"] == ("not found", None, None, None)
    assert got[".env"] == ("blocked by blacklist", "Rule: blacklist = .env") * 2
    assert got["dir"] == got["src"] == got["."] == (directory, None, "included", None)
    assert got[f"out{PACK_SUFFIX}"] == ("excluded because it is the current output file", None) * 2
    assert got["../other"] == got["/abs/x"] == ("outside the scan root", None) * 2
    assert got["build/x"] == got["build"] == ("blocked by ignore filters", None) * 2
    assert got["big.txt"] == ("skipped by max-size", "Rule: max-size = 1 KiB, actual = 2000 bytes", "included", None)


def test_explain_without_tree_and_with_absolute_paths(spark, entries):
    run = Run(entries({"main.rs": ""}), ScanConfig(no_tree=True))
    roots = spark.createDataFrame([("p", "/srv/p")], "project string, root string")
    got = explained(run, spark, "main.rs", "/srv/p/main.rs", "/srv/p", "/srv/px/main.rs", roots=roots)
    assert got["main.rs"] == got["/srv/p/main.rs"] == ("included", None, "disabled by --no-tree", None)
    assert got["/srv/p"][0].startswith("not a content file")
    assert got["/srv/px/main.rs"][0] == "outside the scan root"


def test_every_entry_has_one_decision_and_counts_add_up(entries):
    files = {f"d{i % 5}/f{i}.{'txt' if i % 3 else 'pem'}": "x" * i * 30 for i in range(60)}
    run = Run(entries(files), ScanConfig(exclude="d1/", max_size=1))
    codes = [r.content_code for r in run.decisions.where("is_file").collect()]
    stats = run.stats().first()
    assert len(codes) == len(files)
    assert stats.files_processed == codes.count("included") and stats.files_skipped == codes.count("max_size")
    assert run.decisions.where(included("content")).count() == stats.files_processed


def test_options_per_project(spark, entries):
    both = entries({"a.rs": "", "b.md": ""}, "one").unionByName(entries({"a.rs": "", "b.md": ""}, "two")).unionByName(
        entries({"a.rs": ""}, "bad"))
    options = spark.createDataFrame(
        [("one", "*.rs", None), ("two", None, "a.rs"), ("bad", "[", None)], "project string, include string, exclude string"
    ).selectExpr("*", "cast(null as string) tree_include", "'' tree_exclude", "false no_ignore",
                 "cast(null as boolean) tree_no_ignore", "false no_tree", "false no_blacklist", "500L max_size")
    run = Run(both, options)
    assert values(run.decisions, "project", "rel_path", "content_code", "content_rule", "tree_code") == {
        ("one", "a.rs", "included", None, "included"), ("one", "b.md", "include", "*.rs", "include"),
        ("two", "a.rs", "exclude", "a.rs", "included"), ("two", "b.md", "included", None, "included")}
    asked = spark.createDataFrame([("one", "."), ("two", "."), ("two", "a.rs")], "project string, path string")
    assert values(run.explain(asked), "project", "path", "content_code") == {
        ("one", ".", "include"), ("two", ".", "not_a_file"), ("two", "a.rs", "exclude")}
    error = run.config_errors().first()
    assert error.project == "bad" and "Invalid glob pattern '['" in error.config_error


def test_invalid_glob_fails_before_any_job(entries):
    with pytest.raises(GlobError):
        Run(entries({"a": ""}), ScanConfig(include="["))
