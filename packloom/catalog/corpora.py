"""Inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.sources.content import inspect_bytes
from packloom.sources.corpora import entries_from, pick, table

ROOT_RULES = "# build output\n*.log\n!src/core/**/*.log\n\n/docs/\nes/   \n/a/*/de/2*\n\\#odd\n"
SRC_RULES = "*.md\n!/core/en/*.md\n/core/fr\n"
EXCLUDE_RULES = "*.rs\n"
DENIED = "read: Permission denied (os error 13)"
DIR_DENIED = "list: Permission denied (os error 13)"


def _workspace_path():
    number, text = F.col("doc_id"), F.col("doc_id").cast("string")
    folder = pick(number, "src", "src/core", "docs/en", "config", "Node_Modules/lib", ".env.d", "a/.env.d", "tests")
    ext = pick(number, ".txt", ".md", ".log", ".PEM", ".rs")
    name = (
        F.when(number % 11 == 0, F.concat(text, F.lit("/Credentials.json")))
        .when(number % 13 == 0, F.concat(text, F.lit("/service-account-"), "lang", F.lit(".json")))
        .otherwise(F.concat(text, ext)))
    return F.concat(folder, F.lit("/"), "lang", F.lit("/"), name)


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents laid out like source trees, with names that rules react to."""
    return entries_from(table(spark, sf_dir, "documents"), F.col("source"), _workspace_path(), F.col("text"))


def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore files of every project of :func:`workspaces`, as entries."""
    projects = table(spark, sf_dir, "documents").select(F.col("source").alias("project")).distinct()
    files = F.explode(F.create_map(*[F.lit(x) for pair in (
        (".gitignore", ROOT_RULES), ("src/.ignore", SRC_RULES), (".git/info/exclude", EXCLUDE_RULES),
    ) for x in pair])).alias("rel_path", "content")
    rows = projects.select("project", files)
    return entries_from(rows, F.col("project"), F.col("rel_path"), F.col("content"))


def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ignore file per document, with rules made of the document's own columns."""
    number = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("# "), number, F.lit("\n*."), "lang", F.lit("\n!/"), "source", F.lit("/keep.*  \n\n"), number, F.lit("/\n/"),
        "lang", F.lit("/**/"), number, F.lit(".log"))
    return entries_from(
        table(spark, sf_dir, "documents"), F.col("source"), F.concat("lang", F.lit("/"), number, F.lit("/.gitignore")), text)


def ruled_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces(spark, sf_dir).unionByName(rule_files(spark, sf_dir))


def raw_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workspaces as bytes: some with a zero byte, some malformed, some that cannot be read."""
    number, text = F.col("doc_id"), F.encode("text", "UTF-8")
    data = (
        F.when(number % 17 == 0, F.concat(text, F.lit(bytearray(b"\0"))))
        .when(number % 19 == 0, F.concat(text, F.lit(bytearray(b"\xffa")))).otherwise(text))
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"), _workspace_path().alias("rel_path"), data.alias("content_bytes"),
        F.octet_length(data).cast("bigint").alias("length"), F.lit(False).alias("is_dir"), F.lit(True).alias("is_file"),
        F.when(number % 23 == 0, DENIED).alias("read_error"))
    return inspect_bytes(rows)


def full_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw workspaces with their ignore files."""
    return raw_workspaces(spark, sf_dir).unionByName(rule_files(spark, sf_dir), allowMissingColumns=True)


def first_files(entries: DataFrame) -> DataFrame:
    """One path per project to stand for its current output."""
    return entries.groupBy("project").agg(F.min("rel_path").alias("rel_path"))


def linked_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workspaces with links: inside the root, beside it, far away, and dead."""
    number = F.col("doc_id")
    root = F.concat(F.lit("/corpus/"), "source")
    target = (
        F.when(number % 5 == 1, F.concat(root, F.lit("/src/x"))).when(number % 5 == 2, F.concat(root, F.lit("x/secret")))
        .when(number % 5 == 3, "/etc/passwd").when(number % 5 == 4, ""))
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        F.col("source").alias("project"), _workspace_path().alias("rel_path"), target.alias("link_target"),
        root.alias("root"), F.lit(False).alias("is_dir"), F.octet_length("text").cast("bigint").alias("length"))


def profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile file per document, in every state such a file can be in."""
    docs = table(spark, sf_dir, "documents")
    size, lang = F.col("n_chars").cast("string"), F.col("lang")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    state = F.pmod("doc_id", F.lit(8))
    text = (
        F.when(state == 0, join(
            '{"profiles":{"default":{"include":"*.', lang, '","max_size":', size,
            '},"wide":{"description":"all of ', F.col("source"), '","no_ignore":true,"tree_include":""}}}'))
        .when(state == 1, join('{"include":"*.', lang, '"}'))
        .when(state == 2, "{ definitely not json")
        .when(state == 3, join('{"profiles":{"default":{"max_size":"', size, '"}}}'))
        .when(state == 4, '{"profiles":{}}')
        .when(state == 5, join(
            '{"profiles":{"default":{"exclude":"', lang, '/","no_blacklist":null,"extra":1,"no_tree":false}}}'))
        .when(state == 6, '{"max_size":-1}')
        .otherwise('{"profiles":{}} x'))
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("project"), text.alias("text"))
