"""The whole run, from entries to decisions, packs, previews, explanations and counts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions.content import estimated_tokens
from packloom.operators import explain as explaining
from packloom.operators import budget, intervals, render, stats
from packloom.operators.config import ScanConfig, column_rules, compile_configs, with_configs, without_lists
from packloom.operators.decide import apply_marks, inspection_code, inspection_rule, judge, link_error, marks_of, with_facts, with_links_to, with_marks
from packloom.operators.ignore import ignore_files, ignored_entries, is_ignore_file
from packloom.operators.joins import unique_join
from packloom.operators.profiles import current_outputs
from packloom.operators.saving import measured, saved
from packloom.operators.tree import with_directories
from packloom.sources.content import attach_content, inspect_bytes
from packloom.sources.directory import read_entries, with_failures
from packloom.sources.entries_source import scan_entries


class Run:
    """One scan of a corpus under given options.

    ``config`` is a ScanConfig for all projects, or a DataFrame of resolved options with one row
    per project.  ``outputs`` (project, rel_path) are the current output files, besides those that
    the options name as ``output_path``.  Ignore rules come
    from ``ignore_from`` (project, base_dir, priority, content), by default from the ignore files
    in the corpus.

    ``max_tokens`` caps the tokens of every pack, or of those of a table (project, max_tokens): see
    ``budget.token_cap``.

    Narrow tables without texts are saved when first needed, because plans use them many
    times: the marks on entries (ignored, current output), the outline trees are drawn from, and
    the counted decisions.  Texts cross the network for the packs only; whatever else needs them is
    measured in one pass, of which all counts, previews, caps and break-downs are made.
    """

    def __init__(self, entries: DataFrame, config: ScanConfig | DataFrame, outputs: DataFrame | None = None,
                 ignore_from: DataFrame | None = None, directories: bool = True, tokens=estimated_tokens,
                 max_tokens: int | DataFrame | None = None):
        if "content" not in entries.columns:
            entries = entries.withColumn("content", F.lit(None).cast("string"))
        self.files = with_facts(entries)
        self.listed = with_facts(with_directories(entries)) if directories else self.files
        if not isinstance(config, ScanConfig) and "output_path" in config.columns:
            roots = self.files.select("project", "root").where("root is not null").distinct() if "root" in entries.columns else None
            named = current_outputs(config, roots)
            outputs = named if outputs is None else outputs.select("project", "rel_path").unionByName(named)
        self.outputs = None if outputs is None else with_links_to(outputs, self.files)
        self.tokens = tokens
        self.max_tokens = max_tokens
        self.has_links = "link_target" in entries.columns
        self._ignore_files = ignore_files(entries) if ignore_from is None else ignore_from
        self.configs = None if isinstance(config, ScanConfig) else saved(compile_configs(config))
        self.rules = config.rules() if isinstance(config, ScanConfig) else column_rules()

    @cached_property
    def ignore_files(self) -> DataFrame | None:
        """The ignore files, None when there are none and nothing needs matching."""
        files = saved(self._ignore_files)
        return files if measured(files)["rows"] else None

    @cached_property
    def paths(self) -> DataFrame:
        """``project, rel_path, is_dir`` of every entry."""
        return saved(self.listed.select("project", "rel_path", "is_dir"))

    @cached_property
    def projects(self) -> DataFrame:
        return saved(self.paths.select("project").distinct())

    @cached_property
    def marks(self) -> DataFrame | None:
        """``project, rel_path, ignored, is_output`` of the entries that carry a mark."""
        ignored = None
        if self.ignore_files is not None:
            ignored = ignored_entries(self.paths, self.ignore_files)
        marks = marks_of(ignored, self.outputs)
        return None if marks is None else saved(marks)

    @cached_property
    def outline(self) -> DataFrame:
        """``project, rel_path, is_dir, tree_code`` of every entry."""
        if "counted" in self.__dict__:
            return self.counted.select("project", "rel_path", "is_dir", "tree_code")
        return saved(self.decisions.select("project", "rel_path", "is_dir", "tree_code"))

    @cached_property
    def counted(self) -> DataFrame:
        """The decisions, saved: texts are read once for all that is counted."""
        return saved(self.decisions)

    @cached_property
    def token_cap(self) -> DataFrame:
        """``project, rel_path, block_tokens, tokens_before, kept`` of every included file under the cap."""
        return saved(budget.token_cap(self.counted, self.outline, self.max_tokens, self.tokens))

    @cached_property
    def cuts(self) -> DataFrame:
        """``project, cut_at`` of the projects whose packs the cap cuts."""
        return saved(budget.cuts(self.token_cap))

    @cached_property
    def capped(self) -> DataFrame:
        """The counted decisions, with the code ``token_cap`` for files behind the cut of their project."""
        return self._capped(self.counted)

    def _capped(self, decided: DataFrame) -> DataFrame:
        if self.max_tokens is None:
            return decided
        joined, beyond = budget.beyond_cut(decided, self.cuts)
        return joined.withColumn(
            "content_code", F.when(beyond & render.included("content"), "token_cap").otherwise(F.col("content_code"))).drop("cut_at")

    @cached_property
    def decisions(self) -> DataFrame:
        """Facts, codes and rules of every entry, and the tokens of included files' contents; no cap is applied."""
        tokens = F.when(render.included("content"), self.tokens(F.col("content")))
        judged = self._judge(self.listed).withColumn("content_tokens", tokens).drop("content")
        return apply_marks(with_marks(judged, self.marks), self.rules)

    @cached_property
    def survivors(self) -> DataFrame:
        """``project, rel_path, content`` of the included files."""
        passed = self._judge(self.files).where(render.included("content"))
        final = apply_marks(with_marks(passed, self.marks), self.rules)
        return final.where(render.included("content")).select("project", "rel_path", "content")

    def _judge(self, listed: DataFrame) -> DataFrame:
        if self.configs is None:
            return judge(listed, self.rules)
        return without_lists(judge(with_configs(listed, self.configs), self.rules))

    def config_errors(self) -> DataFrame:
        """Projects held back, and why: options not resolved, an invalid glob, or several rows of options."""
        return self.configs.where("config_error is not null").select("project", "config_error")

    def pack(self) -> DataFrame:
        if self.max_tokens is None:
            return render.pack(self.outline, self.survivors)
        joined, beyond = budget.beyond_cut(self.survivors, self.cuts)
        return render.pack(self.outline, joined.where(~beyond).drop("cut_at"))

    def preview(self) -> DataFrame:
        return render.preview(self.capped, self.rules.max_kib)

    def stats(self) -> DataFrame:
        return stats.run_stats(self.capped, self.outline, self.rules, self.tokens)

    def snapshot(self) -> DataFrame:
        """``project, rel_path, digest, tokens`` of every included file, for ``deltas.token_deltas``; texts are read once."""
        inside = render.included("content")
        judged = self._judge(self.listed).withColumns({
            "content_tokens": F.when(inside, self.tokens(F.col("content"))), "digest": F.when(inside, F.sha2("content", 256))}).drop("content")
        return self._snapshot_of(apply_marks(with_marks(judged, self.marks), self.rules))

    def _snapshot_of(self, decided: DataFrame) -> DataFrame:
        tokens = render.block_tokens(F.col("rel_path"), F.col("content_tokens"), self.tokens)
        return decided.where(render.included("content")).select("project", "rel_path", "digest", tokens.alias("tokens"))

    def token_rollup(self) -> DataFrame:
        return stats.token_rollup(self.capped, self.tokens)

    def directory_tokens(self) -> DataFrame:
        """``project, directory, first, last, files, block_tokens``: what every directory's included files cost, at every depth."""
        tokens = render.block_tokens(F.col("rel_path"), F.col("content_tokens"), self.tokens)
        kept = self.capped.where(F.col("is_dir") | render.included("content"))
        return intervals.directory_totals(kept.select("project", "rel_path", "is_dir", tokens.alias("block_tokens")), ["block_tokens"])

    def explain(self, requested: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        """Decide about the requested paths alone, then put the answers on the requests."""
        located = saved(explaining.located(requested, roots))
        if self.has_links:
            located = explaining.through_links(located, self._directory_links())
        keys = saved(explaining.asked_keys(located))
        roots_asked = keys.where("rel_path = ''").select("project")
        tops = (
            self.projects.join(roots_asked, "project", "left_semi")
            .withColumns({"rel_path": F.lit(""), "is_dir": F.lit(True), "is_file": F.lit(False)}))
        known = self.listed.drop("content").unionByName(with_facts(tops), allowMissingColumns=True)
        asked = saved(unique_join(known, keys, ["project", "rel_path"], "left_semi"))
        ignored = None
        if self.ignore_files is not None:
            # The root itself is never ignored.
            below = with_directories(asked.where("rel_path <> ''"))
            ignored = ignored_entries(below, self.ignore_files, self.paths)
        marks = marks_of(ignored, self.outputs)
        return explaining.explain(located, self._capped(self._final(asked, None if marks is None else saved(marks))))

    def _directory_links(self) -> DataFrame:
        """``project, rel_path, real_path`` of the links to directories; real_path is null outside the root."""
        inside = F.expr("substring(link_target, length(rtrim('/', root)) + 2)")
        return saved(self.files.where("link_target <> '' and not is_file and not is_dir").select(
            "project", "rel_path", F.when(~link_error(), inside).alias("real_path")))

    def _final(self, entries: DataFrame, marks: DataFrame | None) -> DataFrame:
        return apply_marks(with_marks(self._judge(entries), marks), self.rules)


class DirectoryRun(Run):
    """A run over directories: list metadata, read ignore files, judge, then open only what is left.

    What survives is opened once: texts, codes and token counts are saved together, and packs,
    previews, counts and caps are made of them.  ``opened`` counts the files opened for their content.
    With ``prune``, directories that ignore files remove are not entered, so what lies below them is not
    known: packs are the same, and paths in there are not found when explained.
    """

    def __init__(self, spark: SparkSession, roots: list[str] | DataFrame, config: ScanConfig | DataFrame,
                 outputs: DataFrame | None = None, tokens=estimated_tokens, max_tokens: int | DataFrame | None = None, prune: bool = False):
        listed = saved(with_failures(scan_entries(spark, roots, prune=True))) if prune else read_entries(spark, roots)
        rule_rows = listed.where(is_ignore_file(F.col("rel_path")) & F.col("is_file"))
        files = ignore_files(inspect_bytes(attach_content(rule_rows, F.lit(True))))
        super().__init__(listed, config, outputs, ignore_from=files, directories=False, tokens=tokens, max_tokens=max_tokens)
        self.opened = spark.sparkContext.accumulator(0)

    def _read(self, entries: DataFrame, marks: DataFrame | None) -> DataFrame:
        """The entries, with the files that metadata could not rule out opened and looked at."""
        code, opened = F.col("content_code"), F.col("_opened")
        unread = self._unread(entries, marks).withColumn("_opened", code == "included")
        return (
            inspect_bytes(attach_content(unread, opened, self.opened))
            .withColumn("content_code", F.when(opened, inspection_code(self.rules)).otherwise(code))
            .withColumn("content_rule", F.when(opened, inspection_rule(code, self.rules)).otherwise(F.col("content_rule")))
            .drop("_opened"))

    def _unread(self, entries: DataFrame, marks: DataFrame | None) -> DataFrame:
        return super()._final(entries, marks).drop("content", "is_binary", "lossy_utf8")

    def _final(self, entries: DataFrame, marks: DataFrame | None) -> DataFrame:
        return self._read(entries, marks)

    @cached_property
    def outline(self) -> DataFrame:
        unread = self._unread(self.listed, self.marks)
        return saved(unread.select("project", "rel_path", "is_dir", "tree_code"))

    @cached_property
    def read(self) -> DataFrame:
        """Decisions, tokens and, of included files, contents, saved."""
        inside = render.included("content")
        return saved(self._read(self.listed, self.marks).withColumns({
            "content_tokens": F.when(inside, self.tokens(F.col("content"))), "content": F.when(inside, F.col("content"))}))

    @cached_property
    def decisions(self) -> DataFrame:
        return self.read.drop("content")

    @cached_property
    def counted(self) -> DataFrame:
        return self.decisions

    @cached_property
    def survivors(self) -> DataFrame:
        return self.read.where(render.included("content")).select("project", "rel_path", "content")

    def snapshot(self) -> DataFrame:
        return self._snapshot_of(self.read.withColumn("digest", F.sha2("content", 256)))
