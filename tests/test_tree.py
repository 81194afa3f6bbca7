import random

from helpers import values
from pyspark.sql import functions as F

from packloom import ScanConfig
from packloom.functions.paths import path_order
from packloom.operators import joins
from packloom.operators.joins import lookup_join, measured_join, salted_join
from packloom.operators.order import number_rows
from packloom.operators.tree import expand_nodes, tree_lines, with_directories
from packloom.plans.packing import Run


def drawing(files):
    """The tree of ``{path: is_dir}`` drawn by recursion over nested dicts."""
    top = {}
    for path in files:
        here = top
        for part in path.split("/"):
            here = here.setdefault(part, {})

    def draw(node, indent, prefix):
        lines = []
        for i, name in enumerate(sorted(node, key=str.encode)):
            last, path = i == len(node) - 1, prefix + name
            is_dir = files.get(path, True)
            lines.append(indent + ("└── " if last else "├── ") + name + ("/" if is_dir else ""))
            lines += draw(node[name], indent + ("    " if last else "│   "), path + "/")
        return lines

    return draw(top, "", "")


def drawn(lines):
    return [r.line for r in lines.orderBy(path_order(F.col("rel_path"))).collect()]


def test_tree_matches_a_recursive_drawing(entries):
    rng = random.Random(7)
    files = {"/".join(rng.choice(["a", "a-b", "a.b", "é", "Z", "0"]) for _ in range(rng.randint(1, 5))) + f"/f{i}.txt": ""
             for i in range(120)}
    files |= {"empty/": "", "Z/hollow/": ""}
    expected = drawing({p.rstrip("/"): p.endswith("/") for p in files})
    assert drawn(tree_lines(entries(files))) == expected


def test_directories_that_hold_no_match(entries):
    files = {"src/main.rs": "", "docs/": "", "tests/t.rs": ""}
    with_include = Run(entries(files), ScanConfig(include="*.rs")).outline.where("tree_code = 'included'")
    assert values(expand_nodes(with_include), "name") == {"src", "main.rs", "tests", "t.rs"}
    with_exclude = Run(entries(files), ScanConfig(exclude="tests/")).outline.where("tree_code = 'included'")
    assert values(expand_nodes(with_exclude), "name") == {"src", "main.rs", "docs", "tests"}


def test_implied_directories_are_added_once(entries):
    got = with_directories(entries({"a/": "", "a/b/c": "", "a/b/d": ""}))
    assert sorted((r.rel_path, r.is_dir) for r in got.collect()) == [
        ("a", True), ("a/b", True), ("a/b/c", False), ("a/b/d", False)]


def test_a_path_that_is_both_file_and_directory(entries):
    got = expand_nodes(entries({"a": "", "a/b": "", "c/d": ""}))
    assert sorted((r.parent, r.name, r.is_dir) for r in got.collect()) == [
        ("", "a", False), ("", "c", True), ("a", "b", False), ("c", "d", False)]


def test_tree_without_broadcasts(entries, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    files = {f"hot/f{i}": "" for i in range(300)} | {f"d{i % 9}/e{i % 4}/x{i}": "" for i in range(100)}
    assert drawn(tree_lines(entries(files))) == drawing(dict.fromkeys(files, False))


def test_one_directory_with_most_of_the_files(entries):
    files = {f"hot/f{i:04}": "" for i in range(3000)} | {f"d{i}/x": "" for i in range(50)}
    assert drawn(tree_lines(entries(files))) == drawing(dict.fromkeys(files, False))


def test_joins_give_every_row_its_fact(spark):
    big = spark.range(4000).selectExpr("if(id % 3 = 0, 0, id % 40) as k", "id")
    facts = spark.range(38).selectExpr("id as k", "concat('v', id) as v", "if(id = 0, 1333, 100) as n")
    expected = {(r.k, r.id, f"v{r.k}" if r.k < 38 else None) for r in big.collect()}
    for heavy, limit in ((1, 0), (5, 0), (1000, 0), (1000, 10**6)):
        found = lookup_join(big, facts, ["k"], "n", ["id"], heavy_keys=heavy, broadcast_bytes=limit)
        assert values(found, "k", "id", "v") == expected
    small = facts.drop("n")
    assert values(salted_join(big, small, ["k"], ["id"], "left"), "k", "id", "v") == expected
    for limit in (0, 10**6):
        joined = measured_join(big, small, ["k"], ["id"], "left", broadcast_bytes=limit)
        assert values(joined, "k", "id", "v") == expected


def test_numbering_spans_partitions(spark):
    rows = spark.range(5000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('g', id % 50)) as project", "lpad(cast((id * 7919) % 5000 as string), 5, '0') as place")
    got = number_rows(rows, "project", "place").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.project, []).append((r.place, r.seq))
    assert len(got) == 5000
    for members in groups.values():
        assert [seq for _, seq in sorted(members)] == list(range(1, len(members) + 1))
