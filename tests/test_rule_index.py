import random
import re

import pytest

from helpers import values
from packloom.functions import globs
from packloom.functions.paths import file_name
from packloom.operators.ignore import ignore_files, ignored_entries
from packloom.operators.rule_index import first_rules, glob_key, glob_keys, pattern_index
from packloom.operators.tree import with_directories

PARTS = ["src", "ab", "a.b", "x.tar.gz", ".env", ".env.d", "a", "*", "**", "*.gz", "*.b", "a.*", ".*", "?b", "a*b.gz", "[ab]", "x.tar.*", "a?.b", "{src,a}", "*.*"]


def keys_of(path):
    """What the table in the module says about a path."""
    *dirs, name = path.split("/")
    found = {("path", path), ("name", name), ("rest", "")} | {("inside", d) for d in dirs}
    found |= {("below", "/".join(dirs[:k])) for k in range(1, len(dirs) + 1)} | ({("top", dirs[0])} if dirs else set())
    if "." in name:
        found |= {("ext", name.rpartition(".")[2]), ("stem", name.partition(".")[0])}
    return found


@pytest.mark.parametrize("crosses", [True, False])
def test_a_key_never_misses_and_a_sure_key_never_errs(crosses):
    rng = random.Random(1)
    kinds, sure_ones = set(), 0
    paths = ["/".join(rng.choice(["src", "ab", "a.b", "x.tar.gz", ".env", ".env.d", "a", "b.gz", "axb.gz", "aa", "a."]) for _ in range(rng.randint(1, 4)))
             for _ in range(300)]
    for _ in range(1500):
        glob = "/".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4))) if rng.random() < 0.7 else f"**/{rng.choice(PARTS)}"
        if not crosses and glob.endswith("/**"):
            glob += "/*"  # as ignore rules write it
        regex = re.compile(globs.whole(globs.glob_body(glob, crosses)).replace(r"\z", r"\Z"))
        kind, key, sure = glob_key(glob, crosses)
        kinds.add(kind)
        for path in paths:
            has, matches = (kind, key) in keys_of(path), bool(regex.search(path))
            assert has or not matches, (glob, kind, key, path)
            assert not sure or has == matches, (glob, kind, key, path)
        sure_ones += sure
    assert kinds == ({"path", "name", "ext", "top", "below", "inside", "rest"} if crosses else {"name", "ext", "stem", "top", "rest"})
    assert sure_ones > 50


def test_first_rules_equal_the_list_form(spark):
    rng = random.Random(4)
    names = ["src", "ab", "a.b", "x.rs", "y.rs", "a", "docs", "z.tar.gz"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(200)})
    patterns = {project: [rng.choice(["src", "docs/", "*.rs", "a/**", "src/ab", "*/a.b", "x.rs", "**/y.rs", "a*", "src/*.gz", " ab ", "", "docs\\a", "a,z.tar.gz"])
                          for _ in range(5)] for project in "pq"}
    rows = [(project, p) for project in "pqr" for p in paths]
    entries = spark.createDataFrame(rows, "project string, rel_path string").coalesce(2)
    listed = [(project, i, raw) for project, found in patterns.items() for i, raw in enumerate(found)] + [("p", 9, "[bad")]
    index = pattern_index(spark.createDataFrame(listed, "project string, ord int, raw string").coalesce(1))
    assert values(index.where("error is not null"), "project", "raw") == {("p", "[bad")}
    got = {(r.project, r.rel_path): (r.ord, r.rule) for r in first_rules(entries, index).collect()}

    def first(project, path):
        for i, raw in enumerate(patterns.get(project, [])):
            for text, body in globs.compile_patterns(raw):
                if re.search(globs.whole(body).replace(r"\z", r"\Z"), path):
                    return i, text
        return None, None

    assert {key: value[0] for key, value in got.items()} == {(project, p): first(project, p)[0] for project, p in rows}
    assert all(rule is None or (ord_ is not None) for ord_, rule in got.values())


def test_many_rules_of_all_kinds(entries):
    """Rules of a file keep their order whatever their kind: later signs win."""
    rules, expected = [], set()
    files = {f"d{i % 5}/f{i}.t{i % 50}": "" for i in range(400)} | {f"s{i}.x/k": "" for i in range(20)}
    rules += [f"f{i}.t{i % 50}" for i in range(0, 400, 4)] + [f"*.t{i}" for i in range(0, 50, 10)]
    rules += [f"!f{i}.*" for i in range(0, 400, 8)] + ["/d1/*7*", "!/d1/f117.t17", "s1*.x/"]
    for path in files:
        name = path.split("/")[-1]
        number = int(re.sub(r"\D.*", "", name[1:]) or -1)
        if name == "k":
            if path.startswith("s1"):
                expected |= {path, path.split("/")[0]}
            continue
        out = number % 4 == 0 or number % 50 % 10 == 0
        out = out and number % 8 != 0
        if path.startswith("d1/") and "7" in path[3:]:
            out = True
        if path == "d1/f117.t17":
            out = False
        if out:
            expected.add(path)
    table = entries({".gitignore": "\n".join(rules)} | files)
    got = values(ignored_entries(with_directories(table), ignore_files(table)), "rel_path")
    assert got == expected


def test_file_name_keys(spark):
    rows = spark.createDataFrame([("a/b.c",)], "p string")
    assert rows.select(file_name(rows.p)).first()[0] == "b.c"


def test_none_of_the_keys_of_a_pattern_misses():
    rng = random.Random(2)
    names = ["src", "ab", "a.b", "x.tar.gz", ".env", ".env.d", "a", "b.gz", "axb.gz", "aa", "a.", ""]
    paths = ["/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    kinds = set()
    for _ in range(1500):
        glob = rng.choice(["", "", "**/", "*/", "/"]) + "/".join(rng.choice([*PARTS, "***", "a/**", "a*/*"]) for _ in range(rng.randint(1, 4)))
        try:
            regex = re.compile(globs.whole(globs.glob_body(glob)).replace(r"\z", r"\Z"))
        except ValueError:
            continue
        for path in filter(regex.search, paths):
            begins = {("part", c[:n]) for c in path.split("/") for n in range(1, len(c) + 1)}
            has = keys_of(path) | begins | {("begin", path[:n]) for n in range(1, len(path) + 1)} | {("end", path[-n:]) for n in range(1, len(path) + 1)}
            assert set(glob_keys(glob)[0]) <= has, (glob, glob_keys(glob), path)
        kinds |= {kind for kind, _ in glob_keys(glob)[0]}
    assert kinds == {"path", "name", "ext", "top", "below", "inside", "rest", "begin", "end", "part"}


def test_many_patterns_share_no_key(spark):
    """As many patterns as paths: each meets about the paths it matches, not all that share its ending or first directory."""
    raws = [raw for n in range(100, 300) for raw in (f"*/{n}*", f"*{n}.rs", f"src/*{n}.md", f"d{n}/*.txt", f"src/**/{n}.x*")] + ["*.rs", "src/*", "*o*"]
    index = pattern_index(spark.createDataFrame([("p", i, raw) for i, raw in enumerate(raws)], "project string, ord int, raw string"))
    per_key = {(r.kind, r.key): r["count"] for r in index.groupBy("kind", "key").count().collect()}
    assert sum(per_key.values()) == len(raws) and max(per_key.values()) <= 2 and per_key["rest", ""] == 1
    paths = [f"src/a/{n}.{ext}" for n in range(95, 130) for ext in ("rs", "md", "x", "xy")] + [f"{n}/c.txt" for n in range(99, 103)] + ["d101/k/f.txt", "d9/f.txt", "f"]
    entries = spark.createDataFrame([("p", path) for path in paths], "project string, rel_path string")
    got = {r.rel_path: r.rule for r in first_rules(entries, index).collect()}
    regexes = [(raw, re.compile("|".join(globs.whole(body).replace(r"\z", r"\Z") for _, body in globs.compile_patterns(raw)))) for raw in raws]
    assert got == {path: next((raw for raw, regex in regexes if regex.search(path)), None) for path in paths}
