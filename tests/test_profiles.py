import pytest
from helpers import values

from packloom.fixed_values import PACK_SUFFIX, PROFILE_FILE
from packloom.operators import profiles
from packloom.operators.profiles import FIELDS

SCHEMA = "project string, name string, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items())


@pytest.fixture
def table(spark):
    def make(*rows):
        return spark.createDataFrame(
            [(r.get("project", "p"), r["name"], *[r.get(f) for f in FIELDS]) for r in rows], SCHEMA)

    return make


def texts(spark, *values_):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(values_)], "project string, text string")


def test_example_document(spark, entries):
    document = """{"profiles": {"default": {"include": "*.rs,*.toml", "exclude": "target/", "max_size": 300},
        "backend": {"description": "Backend implementation", "include": "src/backend/**,Cargo.toml"}}}"""
    files = profiles.profile_files(entries({PROFILE_FILE: document, f"sub/{PROFILE_FILE}": "{}"}))
    rows = {r.name: r for r in profiles.parse_profiles(files).collect()}
    assert rows["default"].max_size == 300 and rows["default"].exclude == "target/" and rows["default"].no_tree is None
    assert rows["backend"].description == "Backend implementation" and rows["backend"].max_size is None
    assert [(r.name, r.description) for r in profiles.list_profiles(profiles.parse_profiles(files)).collect()] == [
        ("backend", "Backend implementation"), ("default", "No description")]


@pytest.mark.parametrize("text, status", [
    ('{"profiles":{}}', "ok"), ('{"profiles":{"a":{"include":null,"other":[1]}}}', "ok"), (' {"profiles":{"a":{}}}\n', "ok"),
    ('{"include":"x"}', "legacy"), ("{}", "legacy"), ('{"profiles":[]}', "legacy"), ('{"profiles":{"a":{"max_size":"3"}}}', "legacy"),
    ('{"profiles":{"a":{"no_tree":"yes"}}}', "legacy"), ('{"profiles":{"a":null}}', "legacy"),
    ("{ definitely not json", "invalid"), ('{"max_size":-1}', "invalid"), ('{"include":1}', "invalid"), ("[]", "invalid"),
    ("", "invalid"), ('{"profiles":{}} x', "invalid"), ('{"profiles":{}}]', "invalid"), ('{},{}', "invalid"), ("3", "invalid"),
])
def test_document_states(spark, text, status):
    row = profiles.classify_configs(texts(spark, text)).first()
    assert (row.status, row.text) == (status, text)


def test_sizes_of_64_bits(spark):
    """Sizes are unsigned: those beyond a long are the largest long, and one bit more is a wrong type."""
    sizes = {"9223372036854775807": ("ok", 2**63 - 1), "9223372036854775808": ("ok", 2**63 - 1), "18446744073709551615": ("ok", 2**63 - 1),
             "18446744073709551616": ("invalid", None), "99999999999999999999": ("invalid", None), "12345678901234567890.5": ("invalid", None),
             "-9223372036854775809": ("invalid", None), "3.0": ("invalid", None), "7": ("ok", 7)}
    files = texts(spark, *[f'{{"profiles":{{"a":{{"max_size":{size}}}}}}}' for size in sizes])
    status = {r.project: r.status for r in profiles.classify_configs(files).collect()}
    found = {r.project: r.max_size for r in profiles.parse_profiles(files).collect()}
    # A flat reading of such a document has no known field, so a wrong type makes it a legacy one.
    want = {f"p{i}": ("ok" if kind == "ok" else "legacy", size) for i, (kind, size) in enumerate(sizes.values())}
    assert {p: (s, found.get(p)) for p, s in status.items()} == want


def test_bad_documents_yield_no_profiles(spark):
    files = texts(spark, '{"profiles":{"a":{"include":"x"}}}', '{"profiles":{"a":{},"b":{"include":1}}}', "nope")
    assert values(profiles.parse_profiles(files), "project", "name") == {("p0", "a")}


def test_merge_keeps_unset_fields_and_replace_drops_them(table):
    old = table({"name": "default", "include": "*.rs", "max_size": 300}, {"name": "other", "exclude": "y"})
    new = table({"name": "default", "exclude": "x", "max_size": 500}, {"name": "added", "no_tree": False})
    columns = ("name", "include", "exclude", "max_size", "no_tree")
    rest = {("other", None, "y", None, None), ("added", None, None, None, False)}
    assert values(profiles.upsert_profiles(old, new), *columns) == rest | {("default", "*.rs", "x", 500, None)}
    assert values(profiles.upsert_profiles(old, new, replace=True), *columns) == rest | {("default", None, "x", 500, None)}


def test_edits(spark, table):
    old = table(*({"name": n, "include": n} for n in "abcdefgh"), {"project": "broken", "name": "z"})
    rows = [("create", "a", None, "x", "already_exists"), ("create", "new", None, "n", "ok"), ("update", "b", None, None, "ok"),
            ("update", "none", None, "x", "not_found"), ("delete", "c", None, None, "ok"), ("rename", "d", "moved", None, "ok"),
            ("rename", "e", "a", None, "already_exists"), ("rename", "zz", "yy", None, "not_found"),
            ("replace", "f", None, "r", "ok"), ("replace", "no", None, "r", "not_found"), ("save", "g", None, "s", "ok"),
            ("save", "g2", None, "s", "ok"), ("save_whole", "h", None, "w", "ok"), ("save_whole", "h2", None, "w", "ok"),
            ("create", "bad name", None, None, "invalid_name"), ("delete", "", None, None, "invalid_name"),
            ("rename", "a", "b/c", None, "invalid_name")]
    edits = spark.createDataFrame(
        [("p", name, op, new, *[text if f == "exclude" else None for f in FIELDS]) for op, name, new, text, _ in rows]
        + [("broken", "z", "save", None, *[None for _ in FIELDS])],
        "project string, name string, op string, new_name string, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items()))
    statuses = spark.createDataFrame([("p", "ok"), ("broken", "legacy")], "project string, status string")
    assert values(profiles.edit_profiles(old, edits, statuses), "op", "name", "status") == {
        *((op, name, status) for op, name, _, _, status in rows), ("save", "z", "invalid_file")}
    assert values(profiles.apply_edits(old, edits, statuses).where("project = 'p'"), "name", "include", "exclude") == {
        ("a", "a", None), ("new", None, "n"), ("b", "b", None), ("moved", "d", None), ("e", "e", None), ("f", None, "r"),
        ("g", "g", "s"), ("g2", None, "s"), ("h", None, "w"), ("h2", None, "w")}


def test_outputs_named_by_options(spark):
    resolved = spark.createDataFrame([("p", "./out/a.txt"), ("q", "../elsewhere")], "project string, output_path string")
    assert values(profiles.current_outputs(resolved), "project", "rel_path") == {("p", "out/a.txt")}


def test_names(spark):
    names = {"backend.api-1": True, "a_B": True, "backend/api": False, "backend api": False, "": False, "a\n": False, "é": False}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in rows.select("n", profiles.valid_profile_name(rows.n)).collect()} == names


def test_resolution_order_and_missing_profiles(spark, table):
    saved = table({"project": "p1", "name": "default", "include": "*.rs", "max_size": 300, "no_ignore": True},
                  {"project": "p2", "name": "api", "tree_include": "", "tree_no_ignore": True})
    asked = spark.createDataFrame(
        [("p1", None, "*.md"), ("p2", "api", None), ("p3", None, None), ("p4", "api", None), ("p5", "web", None)],
        "project string, requested string, include string")
    statuses = spark.createDataFrame([("p1", "ok"), ("p2", "ok"), ("p5", "ok"), ("p3", "legacy")], "project string, status string")
    got = {r.project: r for r in profiles.resolve_configs(asked, saved, statuses).collect()}
    assert (got["p1"].include, got["p1"].max_size, got["p1"].no_ignore, got["p1"].tree_no_ignore) == ("*.md", 300, True, True)
    assert (got["p2"].tree_include, got["p2"].max_size, got["p2"].no_ignore, got["p2"].tree_no_ignore) == ("", 500, False, True)
    assert got["p1"].output_path == f"p1{PACK_SUFFIX}"
    assert {p: r.config_status for p, r in got.items()} == {
        "p1": "ok", "p2": "ok", "p3": "legacy", "p4": "file_not_found", "p5": "profile_not_found"}
