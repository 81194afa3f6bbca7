"""Mix sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a target in words.  It is taken in complete epochs as often as the target holds
its size; what is left is filled from documents in the order of ``-ln(u) / weight``, u being drawn
from a hash of the id, so that documents of higher quality weight tend to come first and reruns
agree.  The document that crosses the budget is taken in part, by its first words.

No source is sorted as a whole.  Keys fall into ranges that hold about ``RANGE_ROWS`` documents
each: a mixture of exponential distributions tells, from counts by weight alone, which.  Sums per
range are prefix-summed, and only the one range per source in which the budget ends is sorted.

Null texts have no words and are never taken; null sources are one source, the last; repeated rows
are documents of their own; an empty table gives no rows.  A table without any word has targets 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.operators.joins import measured_join
from packloom.operators.order import number_rows
from packloom.operators.saving import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that prose has few of; a document's weight falls with their number per word.
SYMBOLS = "|#$%&*<>{}=~^_"
#: Weights are kept in this many steps: a step of k stands for k / LEVELS.
LEVELS = 4
RANGE_ROWS = 20_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_level(text: str, size: Column) -> Column:
    """1 to LEVELS: LEVELS for prose, less with more symbols per word."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0))
    return F.greatest(F.lit(1), F.ceil(LEVELS / (1 + symbols / F.greatest(size, F.lit(1))))).cast("int")


def sampling_key(doc_id: str, level: Column, seed: str = "") -> Column:
    """``-ln(u) / weight`` with u from the first 52 bits of the md5 of the id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(2**52)
    return -F.log(u) * LEVELS / level


@dataclass(frozen=True)
class Columns:
    doc_id: str = "doc_id"
    text: str = "text"
    source: str = "source"


def _keyed(docs: DataFrame, names: Columns) -> DataFrame:
    """The columns the choice needs, beside those of ``docs`` (the names begin with ``_mix``)."""
    return docs.withColumns({
        "_mix_null": F.col(names.source).isNull(), "_mix_source": F.coalesce(names.source, F.lit("")),
        "_mix_size": word_count(names.text),
    }).withColumn("_mix_level", quality_level(names.text, F.col("_mix_size")))


KEY = ["_mix_null", "_mix_source"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Targets of the sources, which share the words of all by weight, none above ``most`` times its own.

    A source's target is ``weight * level`` up to its bound.  The common level rises to the fixed
    point in a few rounds, each a sum over the sources that already stop at their bound.
    """
    per_level = {f"_n{k}": F.count_if(F.col("_mix_level") == k) for k in range(1, LEVELS + 1)}
    sources = sizes.groupBy(*KEY).agg(
        F.sum("_mix_size").alias("_size"), F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in per_level.items()])
    ordered = number_rows(
        sources.withColumns({"_all": F.lit(0), "_order": F.struct(*KEY)}), "_all", "_order", "_rank").drop("_all", "_order")
    by_rank = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = saved(ordered.withColumn("_weight", by_rank))
    total = sources.agg(F.sum("_size")).first()[0] or 0
    stops = F.col("_size") * most
    level, stopped = 0.0, -1
    while total:
        bound = stops <= F.col("_weight") * F.lit(level)
        n, words, weight = sources.agg(
            F.count_if(bound), F.coalesce(F.sum(F.when(bound, stops)), F.lit(0)),
            F.coalesce(F.sum(F.when(~bound, F.col("_weight"))), F.lit(0))).first()
        if n == stopped or not weight:
            break
        level, stopped = (total - words) / weight, n
    return sources.withColumn("_target", F.least(F.col("_weight") * F.lit(level), stops.cast("double")))


def plan_sources(docs: DataFrame, names: Columns, weights: tuple[int, ...], most: int, range_rows: int = RANGE_ROWS):
    """Sizes of all documents, and per source its target, epochs, and where the fractional selection ends."""
    sizes = saved(_keyed(docs, names).select(F.col(names.doc_id).alias("doc_id"), *KEY, "_mix_size", "_mix_level"))
    facts = source_targets(sizes, weights, most).withColumn(
        "_epochs", F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(0).cast("bigint")
    ).withColumn("_budget", F.floor(F.col("_target") - F.col("_epochs") * F.col("_size") + 0.5).cast("bigint"))
    facts = saved(facts.withColumn("_ranges", F.ceil(F.col("_rows") / range_rows)))
    placed = _ranged(measured_join(sizes, facts, KEY, ["doc_id"]), "doc_id")
    upto = Window.partitionBy(*KEY).orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        placed.groupBy(*KEY, "_mix_range", "_budget").agg(F.sum("_mix_size").alias("_words"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0)))
        .where("_before < _budget and _budget <= _before + _words")
        .select(*KEY, F.col("_mix_range").alias("_end"), "_before"))
    facts = saved(facts.join(ends, KEY, "left").withColumn("_end", F.coalesce("_end", F.lit(-1).cast("bigint"))))
    return sizes, facts


def _ranged(rows: DataFrame, doc_id: str) -> DataFrame:
    """Add the key and its range: the expected share of the source's documents with smaller keys, times the ranges."""
    key = sampling_key(doc_id, F.col("_mix_level"))
    share = sum(
        (F.col(f"_n{k}") * (1 - F.exp(-F.col("_mix_key") * (k / LEVELS))) for k in range(1, LEVELS + 1)), F.lit(0.0)) / F.col("_rows")
    return rows.withColumn("_mix_key", key).withColumn(
        "_mix_range", F.least(F.floor(share * F.col("_ranges")), F.col("_ranges") - 1).cast("bigint"))


def _with_extra(placed: DataFrame, doc_id: str) -> DataFrame:
    """Add ``_extra``, the words taken beyond complete epochs; only the ranges where budgets end are sorted."""
    before = Window.partitionBy(*KEY).orderBy("_mix_key", doc_id, "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_budget") - F.col("_before") - F.coalesce(F.sum("_mix_size").over(before), F.lit(0))
    at_end = placed.where("_mix_range = _end").withColumn(
        "_extra", F.greatest(F.lit(0).cast("bigint"), F.least(F.col("_mix_size"), room)))
    others = placed.where("_mix_range <> _end").withColumn(
        "_extra", F.when(F.col("_mix_range") < F.col("_end"), F.col("_mix_size")).otherwise(F.lit(0).cast("bigint")))
    return at_end.unionByName(others)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, names: Columns = Columns()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, epochs, part_words`` of every document."""
    sizes, facts = plan_sources(docs, names, weights, most)
    placed = _with_extra(_ranged(measured_join(sizes, facts, KEY, ["doc_id"]), "doc_id"), "doc_id")
    whole = F.when(F.col("_mix_size") > 0, F.floor(F.col("_extra") / F.col("_mix_size"))).otherwise(0)
    return placed.select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_epochs") * F.col("_mix_size") + F.col("_extra")).alias("taken"),
        (F.col("_epochs") + whole).cast("int").alias("epochs"),
        F.when(whole == 0, F.col("_extra")).otherwise(0).cast("bigint").alias("part_words"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, names: Columns = Columns()) -> DataFrame:
    """The mixture itself: a row per copy taken, with the columns of ``docs``.

    Texts stay where they are; only documents in ranges where a budget ends are shuffled.  The
    document taken in part keeps its first words, joined by single spaces.
    """
    _, facts = plan_sources(docs, names, weights, most)
    placed = _with_extra(_ranged(measured_join(_keyed(docs, names), facts, KEY, [names.doc_id]), names.doc_id), names.doc_id)
    whole = F.when((F.col("_mix_size") > 0) & (F.col("_extra") == F.col("_mix_size")), 1).otherwise(0)
    part = F.when((F.col("_extra") > 0) & (F.col("_extra") < F.col("_mix_size")), 1).otherwise(0)
    copies = placed.withColumns({"_full": F.when(F.col("_mix_size") > 0, F.col("_epochs") + whole).otherwise(0), "_part": part}).where("_full + _part > 0")
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_full") + F.col("_part"))))
    is_part = F.col("_copy") > F.col("_full")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(names.text), F.lit(WORD), F.lit(0)), F.lit(1), F.col("_extra").cast("int")), " ")
    kept = copies.withColumn(names.text, F.when(is_part, cut).otherwise(F.col(names.text)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(is_part, F.length(names.text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
