"""The registered queries: each operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.catalog import corpora as made
from packloom.functions import content as text_functions
from packloom.functions import globs, paths, rules
from packloom.operators import decide, deltas, exact, explain, ignore, profiles, render, rule_index, stats, tree
from packloom.operators.config import ScanConfig, column_rules, compile_configs, effective_tree_rules, with_configs
from packloom.operators.order import number_rows
from packloom.operators.saving import checkpoint_dir, saved
from packloom.plans.packing import Run
from packloom.sources import corpora, packs
from packloom.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Options used by the queries on workspaces, and by the flagship query on documents.
WORKSPACE = ScanConfig(
    include="*.txt,*.md,*.rs,config", exclude="tests/,src/core/**/9*, fr", max_size=4,
    tree_include="*.txt,*.md,*.log,docs", tree_exclude="")
DOCUMENTS = ScanConfig(include="*.txt,*.md", exclude="de/", max_size=2)
RULE_LIST = "docs/,*.rs,src/core,en,tests/**"
GLOBS = {
    "by_ending": "*.txt", "all_below": "src/**", "fixed_depth": "src/*/en/*", "one_character": "?onfig/*",
    "classes": "[st]*/[!e]?/*", "any_between": "a/**/de/*", "anywhere": "**/fr/*", "choice": "{src,tests}/*",
}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- predicates and filters


@query
def parse_patterns(spark, sf_dir):
    docs = corpora.table(spark, sf_dir, "documents")
    csv = F.concat("lang", F.lit("/, *."), "lang", F.lit(" ,, "), "source", F.lit("\\notes , "), F.col("doc_id").cast("string"))
    each = docs.select(F.col("source").alias("project"), "doc_id", F.posexplode(globs.pattern_list(csv)).alias("ord", "raw"))
    return each.select("project", "doc_id", F.col("ord").cast("bigint").alias("ord"), "raw",
                       F.explode(globs.pattern_globs(F.col("raw"))).alias("glob"))


@query
def glob_match(spark, sf_dir):
    path = F.col("rel_path")
    return made.workspaces(spark, sf_dir).select("project", "rel_path", *[
        path.rlike(globs.whole(globs.glob_body(g))).alias(name) for name, g in GLOBS.items()])


@query
def matched_rule(spark, sf_dir):
    wanted = rules.LiteralRules(RULE_LIST)
    return made.workspaces(spark, sf_dir).select(
        "project", "rel_path", wanted.first_match(F.col("rel_path")).alias("rule"))


def _project_options(spark, sf_dir):
    """Options that differ by project, from the project's own documents."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")
    return corpora.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project")).agg(
        F.concat(F.max("lang"), F.lit(", *"), (F.count("*") % 10).cast("string"), F.lit(".md")).alias("exclude"),
        F.max(number).alias("number"),
    ).select(
        "project", "exclude", F.lit("*.txt,*.md,*.log,*.rs").alias("include"),
        F.lit(None).cast("string").alias("tree_include"), F.when(F.col("number") % 2 == 0, "").alias("tree_exclude"),
        (F.col("number") % 3 == 0).alias("no_ignore"),
        F.when(F.col("number") % 4 == 0, False).when(F.col("number") % 4 == 1, True).alias("tree_no_ignore"),
        (F.col("number") % 5 == 4).alias("no_tree"), (F.col("number") % 7 == 3).alias("no_blacklist"),
        (F.col("number") % 6 + 1).alias("max_size"))


@query
def matched_rule_by_project(spark, sf_dir):
    compiled = saved(compile_configs(_project_options(spark, sf_dir)))
    rows = with_configs(made.workspaces(spark, sf_dir).select("project", "rel_path"), compiled)
    return rows.select("project", "rel_path", column_rules().exclude.first_match(F.col("rel_path")).alias("rule"))


def _document_patterns(spark, sf_dir):
    """A pattern per document for its project, of every kind that can be looked up, and of none."""
    files = made.workspaces(spark, sf_dir).select("project", "rel_path")
    numbered = files.withColumn("ord", F.regexp_extract("rel_path", r"(\d+)(?:\.\w+|/[^/]+)$", 1).cast("bigint"))
    number, top = F.col("ord").cast("string"), F.substring_index("rel_path", "/", 1)
    raw = (
        F.when(F.col("ord") % 8 == 0, F.col("rel_path")).when(F.col("ord") % 8 == 1, F.concat(F.lit("*"), number, F.lit(".rs")))
        .when(F.col("ord") % 8 == 2, F.concat(F.col("rel_path"), F.lit("/"))).when(F.col("ord") % 8 == 3, number)
        .when(F.col("ord") % 8 == 4, F.concat(F.lit(" */"), number, F.lit("* "))).when(F.col("ord") % 8 == 5, F.concat(top, F.lit("/*"), number, F.lit(".md")))
        .when(F.col("ord") % 8 == 6, F.concat(number, F.lit("?.{bad"))).otherwise(F.concat(top, F.lit("/*/"), number, F.lit(".txt"))))
    everything = files.select("project").distinct().select("project", F.explode(F.array(*map(F.lit, ("*.PEM", "config/")))).alias("raw"))
    return numbered.select("project", "ord", raw.alias("raw")).unionByName(everything.withColumn("ord", F.lit(10**9)), allowMissingColumns=True)


@query
def first_rule_by_index(spark, sf_dir):
    """Patterns as rows, as many as files: the first that matches each file."""
    index = rule_index.pattern_index(_document_patterns(spark, sf_dir))
    return rule_index.first_rules(made.workspaces(spark, sf_dir), index)


@query
def blacklist_component(spark, sf_dir):
    return made.ruled_workspaces(spark, sf_dir).select(
        "project", "rel_path", rules.blacklist_component(F.col("rel_path")).alias("rule"))


@query
def blacklist_pattern(spark, sf_dir):
    return made.ruled_workspaces(spark, sf_dir).select(
        "project", "rel_path", rules.blacklist_pattern(F.col("rel_path")).alias("rule"))


def _filtered(spark, sf_dir, no_blacklist):
    path, code = F.col("rel_path"), F.col("code")
    options = WORKSPACE.rules()
    return made.ruled_workspaces(spark, sf_dir).select(
        "project", "rel_path",
        rules.filter_code(path, options.include, options.exclude, F.lit(no_blacklist)).alias("code"),
    ).withColumn("rule", rules.filter_rule(code, path, options.include, options.exclude))


@query
def filter_decision(spark, sf_dir):
    return _filtered(spark, sf_dir, False)


@query
def filter_without_blacklist(spark, sf_dir):
    return _filtered(spark, sf_dir, True)


@query
def ignore_rules(spark, sf_dir):
    entries = made.ruled_workspaces(spark, sf_dir).unionByName(made.document_rules(spark, sf_dir))
    found = ignore.ignore_rules(ignore.ignore_files(entries))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("priority", "line")})


@query
def ignore_apply(spark, sf_dir):
    entries = made.ruled_workspaces(spark, sf_dir)
    ignored = ignore.ignored_entries(tree.with_directories(entries), ignore.ignore_files(entries))
    marks = saved(decide.marks_of(ignored, None))
    return decide.with_marks(entries, marks).select("project", "rel_path", "ignored")


@query
def ignore_switches(spark, sf_dir):
    run = Run(made.ruled_workspaces(spark, sf_dir), _project_options(spark, sf_dir))
    return run.decisions.select("project", "rel_path", "content_code", "tree_code")


@query
def size_decision(spark, sf_dir):
    docs = corpora.table(spark, sf_dir, "documents")
    limit = F.pmod("doc_id", F.lit(5))
    length = F.octet_length("text").cast("bigint")
    return docs.select("doc_id", length.alias("length"), limit.alias("max_kib"),
                       rules.too_large(length, limit).alias("too_large"))


@query
def binary_flag(spark, sf_dir):
    return made.raw_workspaces(spark, sf_dir).select("project", "rel_path", "is_binary")


@query
def decode_lossy(spark, sf_dir):
    return made.raw_workspaces(spark, sf_dir).select(
        "project", "rel_path", "lossy_utf8", F.md5("content").alias("content_md5"))


@query
def unreadable(spark, sf_dir):
    code = decide.inspection_code(WORKSPACE.rules())
    return decide.with_facts(made.raw_workspaces(spark, sf_dir)).withColumn("code", code).select(
        "project", "rel_path", "code", decide.inspection_rule(F.col("code"), WORKSPACE.rules()).alias("rule"))


@query
def content_files_only(spark, sf_dir):
    listed = tree.with_directories(corpora.pages(spark, sf_dir).select("project", "rel_path", "is_dir", "is_file"))
    return listed.select("project", "rel_path", "is_file")


# ---- decisions and explanations


def _full_run(spark, sf_dir):
    entries = made.full_workspaces(spark, sf_dir)
    return Run(entries, WORKSPACE, outputs=made.first_files(made.workspaces(spark, sf_dir)))


@query
def content_decision(spark, sf_dir):
    return _full_run(spark, sf_dir).decisions.select("project", "rel_path", "content_code", "content_rule")


@query
def tree_decision(spark, sf_dir):
    return _full_run(spark, sf_dir).decisions.select("project", "rel_path", "tree_code", "tree_rule")


@query
def tree_rule_inheritance(spark, sf_dir):
    docs, number = corpora.table(spark, sf_dir, "documents"), F.col("doc_id")
    configs = docs.select(
        "doc_id", F.col("lang").alias("include"), F.when(number % 2 == 0, F.col("source")).alias("exclude"),
        F.when(number % 3 == 0, "").when(number % 3 == 1, F.col("source")).alias("tree_include"),
        F.when(number % 5 == 0, "x").alias("tree_exclude"), (number % 2 == 1).alias("no_ignore"),
        F.when(number % 3 == 2, number % 4 == 1).alias("tree_no_ignore"))
    return effective_tree_rules(configs).select("doc_id", "tree_include", "tree_exclude", "tree_no_ignore")


def _requests(spark, sf_dir):
    """Per file: its path, its directory, paths missing and outside, and detours, some through what is no directory."""
    files = made.full_workspaces(spark, sf_dir).select("project", "rel_path")
    path = F.col("rel_path")
    folder = F.regexp_extract(path, "^(.*)/", 1)
    return files.select("project", F.explode(F.array(
        path, F.concat(F.lit("./"), F.substring_index(path, "/", 1), F.lit("/..//"), path), folder, F.concat(path, F.lit(".gone")),
        F.concat(F.lit("a/../../"), path), F.concat(F.lit("nope/../"), path), F.concat(path, F.lit("/.")),
        F.concat(folder, F.lit("/.")))).alias("path")).distinct()


@query
def explain_paths(spark, sf_dir):
    return _full_run(spark, sf_dir).explain(_requests(spark, sf_dir))


@query
def decision_text(spark, sf_dir):
    return explain.report(_full_run(spark, sf_dir).explain(_requests(spark, sf_dir)))


@query
def skip_reason(spark, sf_dir):
    run = _full_run(spark, sf_dir)
    reason = explain.skip_reason(F.col("content_code"), run.rules.max_kib, F.col("length"), F.col("read_error"), F.col("is_dir"))
    return run.decisions.select("project", "rel_path", reason.alias("reason")).where("reason is not null")


@query
def preview_lines(spark, sf_dir):
    return _full_run(spark, sf_dir).preview()


@query
def exclude_outputs(spark, sf_dir):
    entries = made.workspaces(spark, sf_dir).select("project", "rel_path")
    return decide.exclude_outputs(entries, made.first_files(entries))


@query
def contain_links(spark, sf_dir):
    escapes = paths.link_escapes(F.col("link_target"), F.col("root"))
    return made.linked_workspaces(spark, sf_dir).select("project", "rel_path", "link_target", escapes.alias("escapes"))


# ---- trees


def _tree_entries(spark, sf_dir):
    columns = ("project", "rel_path", "is_dir")
    return made.workspaces(spark, sf_dir).select(*columns).unionByName(corpora.pages(spark, sf_dir).select(*columns))


@query
def tree_nodes(spark, sf_dir):
    return tree.expand_nodes(_tree_entries(spark, sf_dir))


@query
def tree_last(spark, sf_dir):
    return tree.mark_last(tree.expand_nodes(_tree_entries(spark, sf_dir))).select("project", "parent", "name", "is_last")


@query
def tree_indent(spark, sf_dir):
    return tree.indented(tree.expand_nodes(_tree_entries(spark, sf_dir))).select("project", "parent", "name", "indent")


@query
def tree_lines(spark, sf_dir):
    return tree.tree_lines(_tree_entries(spark, sf_dir))


@query
def tree_text(spark, sf_dir):
    entries = _tree_entries(spark, sf_dir)
    rows = tree.tree_text(tree.tree_lines(entries), entries.select("project").distinct())
    return number_rows(rows, "project", "path_order", "line_no").select("project", "line_no", "line")


# ---- rendering and order


@query
def escape_path(spark, sf_dir):
    odd = pick_odd(F.col("page_id"))
    return corpora.table(spark, sf_dir, "pages").select(
        "page_id", paths.escape_path(F.concat("url", odd)).alias("escaped"))


def pick_odd(number):
    return corpora.pick(number, '"<&>', "\t\n\r", "\x01\x85\x7f", "")


@query
def frame_blocks(spark, sf_dir):
    return render.blocks(corpora.documents(spark, sf_dir))


@query
def candidate_order(spark, sf_dir):
    docs, number = corpora.table(spark, sf_dir, "documents"), F.col("doc_id")
    sep = corpora.pick(number, "/", "-x/", ".", "/0/")
    rows = docs.select(
        F.col("source").alias("project"), F.concat("lang", sep, number.cast("string")).alias("rel_path"))
    rows = rows.withColumn("place", paths.path_order(F.col("rel_path")))
    return number_rows(rows, "project", "place").select("project", "rel_path", "seq")


@query
def pack_rows(spark, sf_dir):
    packed = Run(corpora.documents(spark, sf_dir), DOCUMENTS).pack()
    return packed.select("project", F.col("section").cast("bigint").alias("section"),
                         F.replace("path_order", F.lit("\0"), F.lit("/")).alias("rel_path"), "value")


def _in_order(lines):
    return number_rows(lines, "project", "place", "line_no").select("project", "line_no", "value")


@query
def write_packs(spark, sf_dir):
    """Lines of the written packs, numbered in the order of the files."""
    folder = f"{checkpoint_dir(spark)}/packs-{uuid.uuid4().hex}"
    packs.write_packs(Run(corpora.documents(spark, sf_dir), DOCUMENTS).pack(), folder)
    return _in_order(packs.read_lines(spark, folder))


@query
def publish_packs(spark, sf_dir):
    """Lines of published packs, after a second run that wrote half of the projects anew."""
    folder = f"{checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    files = corpora.documents(spark, sf_dir)
    packs.publish_packs(Run(files, DOCUMENTS).pack(), folder)
    even = F.pmod(F.regexp_extract("project", r"(\d+)$", 1).cast("int"), F.lit(2)) == 0
    packs.publish_packs(Run(files.where(even), ScanConfig(include="*.txt,*.log", no_tree=True)).pack(), folder)
    return _in_order(packs.read_published(spark, folder))


# ---- streams


def _streamed(spark, sf_dir):
    """The documents as a stream: stopped after its first files, then started again by a new reader for all others.

    The stream reads the documents' own parquet files, split so that they arrive one after the other.
    """
    folder = f"{checkpoint_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    files = corpora.documents(spark, sf_dir)
    halves = files.withColumn("_half", F.pmod(F.xxhash64("rel_path"), F.lit(2)))
    for half in (0, 1):
        halves.where(F.col("_half") == half).drop("_half").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
        arrivals.Arrivals(spark, f"{folder}/out", DOCUMENTS).start(stream).awaitTermination()
    return arrivals.Arrivals(spark, f"{folder}/out", DOCUMENTS)


@query
def streamed_blocks(spark, sf_dir):
    return _streamed(spark, sf_dir).blocks()


@query
def streamed_counts(spark, sf_dir):
    return _streamed(spark, sf_dir).counts()


# ---- counts


@query
def content_tokens(spark, sf_dir):
    columns = ("project", "rel_path", "content")
    files = corpora.documents(spark, sf_dir).select(*columns).unionByName(corpora.pages(spark, sf_dir).select(*columns))
    return corpora.spread(files).select("project", "rel_path", text_functions.estimated_tokens(F.col("content")).alias("content_tokens"))


@query
def exact_tokens(spark, sf_dir):
    """Exact counts of documents and pages under the merge ranks of a public vocabulary."""
    import public_tokenizers

    columns = ("project", "rel_path", "content")
    files = corpora.documents(spark, sf_dir).select(*columns).unionByName(corpora.pages(spark, sf_dir).select(*columns))
    return exact.exact_tokens(corpora.spread(files), exact.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@query
def project_tokens(spark, sf_dir):
    run = Run(corpora.documents(spark, sf_dir), DOCUMENTS)
    return stats.output_tokens(run.decisions, run.outline)


@query
def run_stats(spark, sf_dir):
    return Run(corpora.documents(spark, sf_dir), DOCUMENTS).stats()


@query
def walk_errors(spark, sf_dir):
    files = made.linked_workspaces(spark, sf_dir)
    listed = tree.with_directories(files.withColumn("is_file", F.lit(True)))
    listed = listed.withColumn("read_error", F.when(F.col("rel_path").rlike("^(config|docs|src/core)$"), made.DIR_DENIED))
    rule_rows = ignore.ignore_files(made.rule_files(spark, sf_dir))
    options = ScanConfig(exclude="tests/", tree_no_ignore=True).rules()
    marks = saved(decide.marks_of(ignore.ignored_entries(listed, rule_rows), None))
    marked = decide.with_marks(listed, marks)
    return stats.walk_errors(decide.decide(marked, options), options)


def _caps(spark, sf_dir):
    """A cap by project: some too small for any file, some for all, some none."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")
    cap = F.when(number % 6 != 5, number % 6 * number % 7 * 900 + 150)
    return corpora.table(spark, sf_dir, "documents").select(F.col("source").alias("project"), cap.alias("max_tokens")).distinct()


def _capped_run(spark, sf_dir):
    return Run(made.workspaces(spark, sf_dir), WORKSPACE, max_tokens=_caps(spark, sf_dir))


@query
def token_cap(spark, sf_dir):
    return _capped_run(spark, sf_dir).token_cap


@query
def token_cap_stats(spark, sf_dir):
    return _capped_run(spark, sf_dir).stats()


@query
def token_cap_pack(spark, sf_dir):
    """Rows of packs that are cut, told apart by digests of their values."""
    packed = _capped_run(spark, sf_dir).pack()
    return packed.select("project", F.col("section").cast("bigint").alias("section"),
                         F.replace("path_order", F.lit("\0"), F.lit("/")).alias("rel_path"), F.md5("value").alias("value_md5"))


@query
def directory_tokens(spark, sf_dir):
    """Tokens below every directory, at every depth, of workspaces and of sites."""
    columns = ("project", "rel_path", "content", "is_dir", "is_file", "length")
    files = made.workspaces(spark, sf_dir).select(*columns).unionByName(corpora.pages(spark, sf_dir).select(*columns))
    return Run(files, ScanConfig(exclude="tests/", no_tree=True, max_size=8)).directory_tokens()


@query
def token_rollup(spark, sf_dir):
    return Run(corpora.documents(spark, sf_dir), DOCUMENTS).token_rollup()


def _edited_workspaces(spark, sf_dir):
    """The workspaces after a while: files removed, changed, moved, copied and exchanged for others."""
    files = made.workspaces(spark, sf_dir)
    number = F.regexp_extract("rel_path", r"(\d+)(?:\.\w+|/[^/]+)$", 1).cast("bigint")
    path, text = F.col("rel_path"), F.col("content")
    kept = files.withColumn("n", number).where("n % 10 <> 0")
    moved = F.when(F.col("n") % 10 == 1, F.concat(F.lit("moved/"), path)).otherwise(path)
    cut = F.when(F.col("n") % 10 == 2, F.concat(text, F.lit(" more"))).when(F.col("n") % 10 == 3, F.lit("same text")).otherwise(text)
    copies = kept.where("n % 10 = 4").withColumn("rel_path", F.concat(F.lit("copies/"), path))
    return kept.withColumns({"rel_path": moved, "content": cut}).unionByName(copies).drop("n")


def _deltas(spark, sf_dir):
    config = ScanConfig(include="*.txt,*.md,*.rs,*.log")
    return deltas.token_deltas(*[Run(files, config).snapshot() for files in (made.workspaces(spark, sf_dir), _edited_workspaces(spark, sf_dir))])


@query
def token_deltas(spark, sf_dir):
    return _deltas(spark, sf_dir)


@query
def token_delta_totals(spark, sf_dir):
    return deltas.delta_totals(_deltas(spark, sf_dir))


# ---- profiles


@query
def classify_config(spark, sf_dir):
    return profiles.classify_configs(made.profile_texts(spark, sf_dir)).select("project", "status")


@query
def parse_profiles(spark, sf_dir):
    return profiles.parse_profiles(made.profile_texts(spark, sf_dir))


def _profile_requests(spark, sf_dir):
    docs, number = corpora.table(spark, sf_dir, "documents"), F.col("doc_id")
    return docs.select(
        F.concat(F.lit("doc-"), number.cast("string")).alias("project"),
        F.when(number % 3 == 1, "wide").when(number % 3 == 2, "default").alias("requested"),
        F.when(number % 4 == 0, F.col("lang")).alias("include"), F.when(number % 5 == 0, F.lit(True)).alias("no_tree"))


@query
def resolve_config(spark, sf_dir):
    files = made.profile_texts(spark, sf_dir)
    return profiles.resolve_configs(
        _profile_requests(spark, sf_dir), profiles.parse_profiles(files), profiles.classify_configs(files))


def _profiled_run(spark, sf_dir):
    """Workspaces under options that are resolved from a profile file per project, in every state.

    A project's file is that of its first document; every seventh project asks for nothing and has
    no row of options, and every sixth asks for a profile.
    """
    entries = made.workspaces(spark, sf_dir)
    first = corpora.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project")).agg(F.min("doc_id").alias("doc_id"))
    number = F.regexp_extract("project", r"(\d+)$", 1).cast("bigint")
    texts = made.profile_texts(spark, sf_dir).withColumnRenamed("project", "_doc")
    files = first.join(texts, F.concat(F.lit("doc-"), first["doc_id"].cast("string")) == texts["_doc"]).select("project", "text")
    asked = first.where(number % 7 != 6).select(
        "project", F.when(number % 6 == 5, "wide").alias("requested"), F.when(number % 5 == 1, "a/").alias("exclude"),
        F.when(number % 4 == 1, "src/../docs/./en/out.md").alias("output_path"))
    twice = asked.where(number % 11 == 8)
    resolved = profiles.resolve_configs(asked, profiles.parse_profiles(files), profiles.classify_configs(files))
    return Run(entries, resolved.unionByName(resolved.join(twice.select("project"), "project", "left_semi")))


@query
def profile_run(spark, sf_dir):
    run = _profiled_run(spark, sf_dir)
    return run.decisions.select("project", "rel_path", "content_code", "content_rule", "tree_code")


@query
def config_errors(spark, sf_dir):
    return _profiled_run(spark, sf_dir).config_errors()


@query
def current_outputs(spark, sf_dir):
    """Outputs inside and outside of their projects, by relative and absolute paths."""
    docs, number = corpora.table(spark, sf_dir, "documents"), F.col("doc_id")
    project, name = F.concat(F.lit("doc-"), number.cast("string")), F.concat("lang", F.lit(".md"))
    root = F.concat(F.lit("/corpus/"), project)
    path = (
        F.when(number % 6 == 0, F.concat(F.lit("./out//"), name)).when(number % 6 == 1, F.concat(F.lit("../"), name))
        .when(number % 6 == 2, F.concat(root, F.lit("/out/../"), name)).when(number % 6 == 3, F.concat(F.lit("/elsewhere/"), name))
        .when(number % 6 == 4, F.concat(root, F.lit("x/"), name)).otherwise(".."))
    return profiles.current_outputs(docs.select(project.alias("project"), path.alias("output_path")),
                                    docs.select(project.alias("project"), root.alias("root")))


@query
def missing_profile(spark, sf_dir):
    """Requests against the files of every other document only, so that some have no file."""
    files = made.profile_texts(spark, sf_dir)
    known = files.withColumn("project", F.regexp_replace("project", "[02468]$", "x"))
    resolved = profiles.resolve_configs(
        _profile_requests(spark, sf_dir), profiles.parse_profiles(known), profiles.classify_configs(known))
    return resolved.select("project", "profile", "config_status")


def _profile_changes(spark, sf_dir):
    docs, number = corpora.table(spark, sf_dir, "documents"), F.col("doc_id")
    values = {
        "description": F.when(number % 2 == 0, F.concat(F.lit("new "), "source")), "output_path": F.lit("out.txt"),
        "exclude": F.when(number % 3 == 0, F.col("lang")), "max_size": F.when(number % 5 == 0, number)}
    return docs.select(
        F.concat(F.lit("doc-"), number.cast("string")).alias("project"),
        F.when(number % 16 < 8, "default").otherwise("added").alias("name"),
        *[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in profiles.FIELDS.items()])


@query
def upsert_profiles(spark, sf_dir):
    existing = profiles.parse_profiles(made.profile_texts(spark, sf_dir))
    return profiles.upsert_profiles(existing, _profile_changes(spark, sf_dir))


@query
def replace_profiles(spark, sf_dir):
    existing = profiles.parse_profiles(made.profile_texts(spark, sf_dir))
    return profiles.upsert_profiles(existing, _profile_changes(spark, sf_dir), replace=True)


def _profile_edits(spark, sf_dir):
    number = F.regexp_extract("project", r"(\d+)$", 1).cast("bigint")
    op = corpora.pick(F.floor(number / 8), "create", "update", "delete", "rename", "replace", "save", "save_whole")
    changes = _profile_changes(spark, sf_dir).drop("name")
    edits = changes.select(
        "*", op.alias("op"), corpora.pick(F.floor(number / 56), "default", "wide", "extra", "not valid").alias("name"),
        F.when(op == "rename", corpora.pick(F.floor(number / 64), "moved", "wide")).alias("new_name"))
    # Some projects get further edits of the same table, a few of which claim one name twice.
    more = lambda every, op, name, new: changes.where(number % every == 0).select(
        "*", F.lit(op).alias("op"), F.lit(name).alias("name"), F.lit(new).cast("string").alias("new_name"))
    return edits.unionByName(more(16, "rename", "wide", "moved")).unionByName(more(48, "create", "moved", None))


@query
def edit_profiles(spark, sf_dir):
    files = made.profile_texts(spark, sf_dir)
    outcome = profiles.edit_profiles(
        profiles.parse_profiles(files), _profile_edits(spark, sf_dir), profiles.classify_configs(files))
    return outcome.select("project", "op", "name", "new_name", "status")


@query
def apply_profile_edits(spark, sf_dir):
    files = made.profile_texts(spark, sf_dir)
    after = profiles.apply_edits(
        profiles.parse_profiles(files), _profile_edits(spark, sf_dir), profiles.classify_configs(files))
    return after.select("project", "name", "description", "include", "exclude", "max_size")


@query
def valid_profile_name(spark, sf_dir):
    docs = corpora.table(spark, sf_dir, "documents")
    name = F.concat(
        F.when(F.col("doc_id") % 6 == 5, "").otherwise(F.col("lang")),
        corpora.pick(F.col("doc_id"), ".api-1", "/api", " api", "_api\n", "é", ""))
    return docs.select("doc_id", name.alias("name"), profiles.valid_profile_name(name).alias("valid"))


@query
def list_profiles(spark, sf_dir):
    return profiles.list_profiles(profiles.parse_profiles(made.profile_texts(spark, sf_dir)))
