import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpers import values
from packloom import ScanConfig
from packloom.fixed_values import BLOCK_CLOSING
from packloom.operators import budget
from packloom.operators.intervals import directories_of, directory_totals
from packloom.operators.order import running_sums
from packloom.plans.packing import Run

FILES = {"a/1.txt": "one two three", "a/2.txt": "x " * 40, "a-b/3.txt": "z", "b.txt": "end", "c/": None}
count = F.length  # a token is a character, so that sums are plain


def block(path, text):
    return len(f'<file path="{path}">\n{text}{BLOCK_CLOSING}')


ORDER = [p for p in ("a/1.txt", "a/2.txt", "a-b/3.txt", "b.txt")]
SIZES = [block(p, FILES[p]) for p in ORDER]


@pytest.fixture
def capped(entries):
    def run(max_tokens, **options):
        return Run(entries(FILES), ScanConfig(no_tree=True, **options), tokens=count, max_tokens=max_tokens)
    return run


def test_cut_at_the_first_block_that_does_not_fit(entries, spark):
    """Many caps at once, each a project's."""
    caps = {f"p{n}{name}": (sum(SIZES[:n]) + more, max(0, n + min(more, 0))) for n in range(5) for name, more in (("=", 0), ("-", -1), ("+", 1))}
    files = reduce(DataFrame.unionByName, [entries(FILES, project) for project in caps])
    limits = spark.createDataFrame([(project, cap) for project, (cap, _) in caps.items()], "project string, max_tokens bigint")
    run = Run(files.coalesce(2), ScanConfig(no_tree=True), tokens=count, max_tokens=limits)
    # An equal cap keeps the block.  A smaller block behind one that is too large is left out, too.
    kept = {(project, p) for project, (_, n) in caps.items() for p in ORDER[:n]}
    assert values(run.token_cap.where("kept"), "project", "rel_path") == kept
    assert values(run.pack(), "project", "path_order") == {(project, p.replace("/", "\0")) for project, p in kept}
    assert values(run.stats(), "project", "files_processed", "files_skipped", "output_tokens") == {
        (project, n, 4 - n, sum(SIZES[:n])) for project, (_, n) in caps.items()}


def test_tokens_before_and_lines(capped):
    run = capped(SIZES[0])
    assert values(run.token_cap, "rel_path", "tokens_before") == {(p, sum(SIZES[:i])) for i, p in enumerate(ORDER)}
    lines = values(run.preview(), "status_line")
    assert "[EXPECT] a/1.txt (13 content tokens)" in lines and "[SKIP] b.txt (beyond the token cap)" in lines
    requests = run.files.sparkSession.createDataFrame([("p", "a/1.txt"), ("p", "b.txt")], "project string, path string")
    assert values(run.explain(requests), "path", "content_code") == {("a/1.txt", "included"), ("b.txt", "token_cap")}


def test_the_tree_takes_its_part(entries, spark):
    files = entries(FILES, "p").unionByName(entries(FILES, "q"))
    tree = sum(len(r.value) for r in Run(entries(FILES), ScanConfig(), tokens=count).pack().where("section = 0").collect())
    caps = spark.createDataFrame([("p", tree + SIZES[0]), ("q", 1)], "project string, max_tokens bigint")
    packed = Run(files, ScanConfig(), tokens=count, max_tokens=caps).pack().groupBy("project", "section").count()
    assert values(packed, "project", "section", "count") == {("p", 0, 8), ("p", 1, 1), ("q", 0, 8)}


def test_caps_by_project(entries, spark):
    both = entries(FILES, "p").unionByName(entries(FILES, "q")).unionByName(entries(FILES, "r"))
    caps = spark.createDataFrame([("p", SIZES[0]), ("p", 9999), ("q", None), ("gone", 1)], "project string, max_tokens bigint")
    run = Run(both, ScanConfig(no_tree=True), tokens=count, max_tokens=caps)
    kept = {r.project: r.n for r in run.token_cap.where("kept").groupBy("project").agg(F.count("*").alias("n")).collect()}
    assert kept == {"p": 1, "q": 4, "r": 4}
    assert values(run.cuts, "project", "cut_at") == {("p", "a\0002.txt")}


def test_nothing_to_cap(entries):
    run = Run(entries({"no.pem": "x"}), ScanConfig(no_tree=True), tokens=count, max_tokens=5)
    assert run.token_cap.count() == 0 and run.pack().count() == 0
    assert values(run.stats(), "files_processed", "output_tokens") == {(0, 0)}


def test_running_sums_of_a_hot_project(spark):
    """One project holds most rows; its sums are right and its rows lie in many partitions."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 50).cast("string"))).alias("project"),
        F.format_string("%05d", F.pmod(F.col("id") * 7919, F.lit(6000))).alias("place"), (F.col("id") % 17).alias("n"), F.lit(1).cast("bigint").alias("one"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        summed = running_sums(rows, "project", ["place"], {"before": "n", "seq": "one"})
        plan = summed._jdf.queryExecution().toString()
        got = summed.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "_part#" in next(line for line in plan.splitlines() if "Window [" in line)
    expected, by_project = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.project, r.place)):
        expected[r.project, r.place] = by_project.get(r.project, (0, 0))
        n, k = expected[r.project, r.place]
        by_project[r.project] = (n + r.n, k + 1)
    assert {(r.project, r.place): (r.before, r.seq) for r in got} == expected


def brute_totals(files, directories):
    all_dirs = {""} | {"/".join(p.split("/")[:k]) for p in list(files) + list(directories) for k in range(1, len(p.split("/")) + (p in directories))}
    nodes = sorted(all_dirs | set(files), key=lambda p: [] if p == "" else p.encode().split(b"/"))
    number = {p: i for i, p in enumerate(nodes)}
    out = set()
    for d in all_dirs:
        inside = [p for p in nodes if d == "" or p == d or p.startswith(d + "/")]
        mine = [p for p in inside if p in files]
        out.add((d, number[d], max(number[p] for p in inside), len(mine), sum(files[p] for p in mine)))
    return out


def test_interval_totals_equal_brute_force(spark):
    rng = random.Random(2)
    # Names around the separator's place in the order, and control characters.
    names = ["a", "a-b", "a.b", "a\x01", "a\x01b", "b", "\x01", "ab", "é", "z"]
    files = {"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))): rng.randint(0, 9) for _ in range(150)}
    files = {p: n for p, n in files.items() if not any(q.startswith(p + "/") for q in files)}
    directories = {"empty", "deep/empty/one"} | {p.rsplit("/", 1)[0] for p in list(files)[:9] if "/" in p}
    rows = [("p", p, False, n) for p, n in files.items()] + [("p", d, True, 77) for d in directories] + [("q", "only", False, None)]
    entries = spark.createDataFrame(rows, "project string, rel_path string, is_dir boolean, w bigint").repartition(5)
    got = directory_totals(entries, ["w"])
    assert values(got.where("project = 'p'"), "directory", "first", "last", "files", "w") == brute_totals(files, directories)
    assert values(got.where("project = 'q'"), "directory", "first", "last", "files", "w") == {("", 0, 1, 1, 0)}
    assert directory_totals(entries.limit(0), ["w"]).count() == 0
    plan = directories_of(entries)._jdf.queryExecution().optimizedPlan().toString()
    # Distinct directories are found before any path is taken apart into its ancestors.
    assert plan.rindex("Aggregate") > plan.index("Generate")


def test_rollup_totals_equal_the_run(entries):
    run = Run(entries(FILES), ScanConfig(exclude="a-b/", max_size=1), tokens=count)
    rows = run.token_rollup()
    (total,) = rows.where("level = 15").collect()
    assert (total.files, total.block_tokens) == (4, sum(SIZES) - SIZES[2])
    assert values(rows.where("level = 0"), "top_dir", "extension", "code", "files") == {
        ("a", ".txt", "included", 2), ("a-b", ".txt", "exclude", 1), ("", ".txt", "included", 1)}
    (stats,) = run.stats().collect()
    blocks = rows.where("level = 7").agg(F.sum("block_tokens")).first()[0]
    tree = sum(len(r.value) for r in run.pack().where("section = 0").collect())
    assert stats.output_tokens == blocks + tree


def test_cap_plan_moves_no_project_to_one_task(capped):
    run = capped(1)
    placed = budget.token_cap(run.counted, run.outline, 100, count)
    assert "content#" not in placed._jdf.queryExecution().executedPlan().toString()
