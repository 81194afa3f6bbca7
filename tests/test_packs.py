import base64
import os

import pytest
from helpers import values
from pyspark.sql import functions as F

from packloom import ScanConfig
from packloom.fixed_values import PACK_SUFFIX
from packloom.functions.content import estimated_tokens
from packloom.plans.packing import DirectoryRun, Run
from packloom.sources.directory import read_entries
from packloom.sources.packs import outline_of, part_number, publish_packs, read_manifest, read_published, write_packs


def written(path, project):
    folder = os.path.join(path, f"project={project}")
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    return b"".join(open(os.path.join(folder, n), "rb").read() for n in names).decode()


FILES = {"z.txt": "last", "a-b/x.txt": "one\ntwo\n", "a/b.txt": "", "a.txt": "</file>\r\n", ".hidden": "h", "no.pem": "secret"}
PACK = (
    "p/\n├── .hidden\n├── a/\n│   └── b.txt\n├── a-b/\n│   └── x.txt\n├── a.txt\n└── z.txt\n"
    '<file path=".hidden">\nh\n</file>\n\n<file path="a/b.txt">\n\n</file>\n\n'
    '<file path="a-b/x.txt">\none\ntwo\n\n</file>\n\n<file path="a.txt">\n</file>\r\n\n</file>\n\n'
    '<file path="z.txt">\nlast\n</file>\n\n')


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_pack_bytes(entries, tmp_path, parts):
    out = str(tmp_path / "packs")
    write_packs(Run(entries(FILES), ScanConfig()).pack(), out, parts)
    assert written(out, "p") == PACK


def test_partitioning_does_not_change_the_pack(entries, tmp_path):
    files = {f"d{i % 7}/f{i}.txt": f"text {i}\n" * (i % 4) for i in range(200)}
    texts = []
    for n in (1, 9):
        out = str(tmp_path / f"packs{n}")
        write_packs(Run(entries(files).repartition(n), ScanConfig()).pack(), out, n)
        texts.append(written(out, "p"))
    assert texts[0] == texts[1] and texts[0].count("<file path=") == 200


def test_a_failed_run_keeps_the_old_pack(entries, spark, tmp_path):
    out = str(tmp_path / "packs")
    write_packs(Run(entries(FILES), ScanConfig()).pack(), out)
    rows = Run(entries(FILES | {"new.txt": "n"}), ScanConfig()).pack()
    broken = rows.withColumn("value", F.when(F.col("path_order") == "z.txt", F.raise_error(F.lit("render failed"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="render failed"):
        write_packs(broken, out)
    assert written(out, "p") == PACK
    write_packs(rows, out)
    assert "new.txt" in written(out, "p")


def test_other_projects_stay_and_the_folder_must_exist(entries, tmp_path):
    out = str(tmp_path / "packs")
    write_packs(Run(entries(FILES, "p"), ScanConfig()).pack(), out)
    write_packs(Run(entries({"x": "1"}, "q"), ScanConfig()).pack(), out)
    assert written(out, "p") == PACK and written(out, "q").startswith("q/\n└── x\n")
    with pytest.raises(FileNotFoundError, match="Output directory does not exist"):
        write_packs(Run(entries(FILES), ScanConfig()).pack(), str(tmp_path / "no" / "packs"))


def test_parts_are_even_though_projects_are_not(entries):
    files = {f"d{i % 7}/f{i}.txt": f"text {i}\n" * (i % 40) for i in range(300)}
    rows = Run(entries(files, "big").unionByName(entries({"a": "1"}, "s1")).unionByName(entries({"b": "2"}, "s2")), ScanConfig(no_tree=True)).pack()
    outline = outline_of(rows)
    parts, number = part_number(outline, 6)
    sizes = [r.n for r in rows.withColumn("part", number).groupBy("part").agg(F.sum(F.octet_length("value")).alias("n")).collect()]
    assert len(sizes) == parts == 6 and max(sizes) <= 1.5 * sum(sizes) / 6


def test_publishing_shows_all_projects_of_a_run_at_once(entries, spark, tmp_path):
    out = str(tmp_path / "packs")

    def shown():
        lines = read_published(spark, out).orderBy("project", "place").collect()
        return {p: "".join(r.value + "\n" for r in lines if r.project == p) for p in {r.project for r in lines}}

    assert read_manifest(spark, out).count() == 0
    both = entries(FILES, "p").unionByName(entries({"x": "1"}, "q"))
    assert publish_packs(Run(both, ScanConfig()).pack(), out) == 1
    first = shown()
    assert first["p"] == PACK and set(first) == {"p", "q"}
    # The second run fails on its last project: neither is replaced.
    rows = Run(entries({"new": "n"}, "p").unionByName(entries({"y": "2"}, "q")), ScanConfig()).pack()
    broken = rows.withColumn("value", F.when(F.col("path_order") == "y", F.raise_error(F.lit("render failed"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="render failed"):
        publish_packs(broken, out)
    assert shown() == first
    # One that leaves a project out keeps it, and earlier versions can still be read.
    assert publish_packs(Run(entries({"y": "2"}, "q"), ScanConfig(no_tree=True)).pack(), out) == 2
    assert shown() == {"p": PACK, "q": '<file path="y">\n2\n</file>\n\n'}
    assert values(read_manifest(spark, out, 1), "project", "version") == {("p", 1), ("q", 1)}


def test_no_tree(entries):
    packed = Run(entries(FILES), ScanConfig(no_tree=True)).pack()
    assert values(packed, "section") == {1}


def make_directory(root):
    (root / "src").mkdir(parents=True)
    (root / "src" / "main.rs").write_text("fn main() {}\n")
    (root / "src" / "_gen.rs").write_text("")
    (root / "legacy.rs").write_bytes(b"\xffa")
    (root / "late.rs").write_bytes(b"x" * 1500 + b"\0")
    (root / "over.rs").write_text("x" * 2049)
    (root / "notes.md").write_text("n")
    (root / ".env").write_text("KEY=1")
    (root / ".gitignore").write_text("build/\n")
    (root / "build").mkdir()
    (root / "build" / "out.rs").write_text("no")
    (root / "empty").mkdir()
    outside = root.parent / "secret.rs"
    outside.write_text("secret")
    (root / "linked.rs").symlink_to(outside)
    (root / "inner.rs").symlink_to(root / "src" / "main.rs")
    (root / "dead.rs").symlink_to(root / "nowhere")
    (root / f"old{PACK_SUFFIX}").write_text("previous")
    (root / "again.rs").symlink_to(root / f"old{PACK_SUFFIX}")


def test_directory_listing(spark, tmp_path):
    root = tmp_path / "proj"
    make_directory(root)
    table = spark.createDataFrame([("proj", str(root))], "project string, root string")
    for roots in ([str(root)], table):
        rows = {r.rel_path: r for r in read_entries(spark, roots).collect()}
        assert len(rows) == 17 and rows["empty"].is_dir and rows["src/_gen.rs"].length == 0
        assert rows["linked.rs"].link_target == str(tmp_path / "secret.rs") and rows["dead.rs"].link_target == ""
        assert rows["late.rs"].length == 1501 and rows[".env"].is_file and rows["src"].project == "proj"
    two = read_entries(spark, [str(root / "src"), str(root / "build")])
    assert values(two, "project", "rel_path") == {("src", "main.rs"), ("src", "_gen.rs"), ("build", "out.rs")}
    with pytest.raises(Exception, match="Scan path must be a directory"):
        read_entries(spark, [str(root / "notes.md")])


def test_directory_run(spark, tmp_path):
    root = tmp_path / "proj"
    make_directory(root)
    outputs = spark.createDataFrame([("proj", f"old{PACK_SUFFIX}")], "project string, rel_path string")
    run = DirectoryRun(spark, [str(root)], ScanConfig(include="*.rs", tree_include="*", max_size=2, no_blacklist=True), outputs=outputs)
    out = str(tmp_path / "packs")
    write_packs(run.pack(), out)
    text = written(out, "proj")
    assert text.startswith(
        "proj/\n├── .env\n├── .gitignore\n├── dead.rs\n├── empty/\n├── inner.rs\n├── late.rs\n├── legacy.rs\n├── linked.rs\n"
        "├── notes.md\n├── over.rs\n└── src/\n    ├── _gen.rs\n    └── main.rs\n<file path=\"inner.rs\">\nfn main() {}\n\n</file>\n\n"
        "<file path=\"legacy.rs\">\n�a\n</file>\n\n")
    assert "secret" not in text and "previous" not in text and "build" not in text
    stats = run.stats().first()
    # skipped: over.rs, late.rs, and two links that lead nowhere allowed
    assert (stats.files_processed, stats.files_skipped) == (4, 4)
    lines = values(run.preview(), "status_line")
    assert "[SKIP] over.rs (larger than 2 KiB: 2049 bytes)" in lines and "[SKIP] late.rs (binary file)" in lines
    assert any(line.startswith("[EXPECT] legacy.rs (") and line.endswith(" content tokens, lossy UTF-8)") for line in lines)
    # Pack, counts and preview together opened each file once that rules and size let through: four survivors and late.rs.
    assert run.opened.value == 5
    asked = spark.createDataFrame(
        [("proj", p) for p in ("linked.rs", "dead.rs", "late.rs", "legacy.rs", "src", "build/out.rs")], "project string, path string")
    assert values(run.explain(asked), "path", "content_code", "tree_code") == {
        ("linked.rs", "outside_root", "included"), ("dead.rs", "not_found", None), ("late.rs", "binary", "included"),
        ("legacy.rs", "included_lossy", "included"), ("src", "include", "included"), ("build/out.rs", "ignore", "ignore")}


def test_directories_with_options_of_their_own(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.rs").write_text("x" * 1500)
        (tmp_path / name / "b.md").write_text("y")
    options = spark.createDataFrame([("one", "*.rs", 2), ("two", None, 1)], "project string, include string, max_size long").selectExpr(
        "*", "cast(null as string) exclude", "'' tree_include", "'' tree_exclude", "false no_ignore",
        "false tree_no_ignore", "false no_tree", "false no_blacklist")
    run = DirectoryRun(spark, [str(tmp_path / "one"), str(tmp_path / "two")], options)
    assert values(run.decisions, "project", "rel_path", "content_code") == {
        ("one", "a.rs", "included"), ("one", "b.md", "include"), ("two", "a.rs", "max_size"), ("two", "b.md", "included")}
    assert values(run.pack().where("section = 1"), "project", "path_order") == {("one", "a.rs"), ("two", "b.md")}


@pytest.mark.skipif(os.geteuid() == 0, reason="root can read everything")
def test_unreadable_file(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "locked.txt").write_text("x")
    (root / "locked.txt").chmod(0)
    run = DirectoryRun(spark, [str(root)], ScanConfig())
    assert run.decisions.first().content_rule == "read: Permission denied (os error 13)"


def test_file_that_vanishes_is_a_skip(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "a.txt").write_text("a")
    (root / "b.txt").write_text("b")
    run = DirectoryRun(spark, [str(root)], ScanConfig())
    (root / "a.txt").unlink()
    assert values(run.decisions, "rel_path", "content_code", "content_rule") == {
        ("a.txt", "unreadable", "read: No such file or directory (os error 2)"), ("b.txt", "included", None)}


def test_estimate_counts_pieces(spark):
    texts = {"": 0, "Hello, world!": 4, "a  b": 3, "12345": 2, "x\n\n  y": 4, "don't <|endoftext|>": 4}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in rows.select("t", estimated_tokens(F.col("t"))).collect()} == texts


def test_tree_tokens_add_up_over_lines(spark, entries):
    files = {f"a {i}/b.{i}/  c\t{i}.txt": "" for i in range(30)}
    run = Run(entries(files), ScanConfig())
    tree = [r.value for r in run.pack().where("section = 0").orderBy("path_order").collect()]
    rows = spark.createDataFrame([("".join(tree), 0)] + [(line, 1) for line in tree], "t string, k int")
    sums = {r[0]: r[1] for r in rows.groupBy("k").agg(F.sum(estimated_tokens(F.col("t")))).collect()}
    assert sums[0] == sums[1]
