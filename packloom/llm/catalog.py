"""The registered queries of this package: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm import chat, fingerprints, language, minhash, mixing, negatives, neighbours, periods, quality, suffix_tree, toxicity
from packloom.llm.common import held_out, remainder, table
from packloom.llm.packing import pack_documents
from packloom.llm.token_counts import count_tokens

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "word_bpe_49k.json"
CONTEXT = 2048


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), CONTEXT)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, 20)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    return language.identify(docs, language.train_languages(docs, ~out), out)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train_ftrl(docs, labels, "toxic", remainder("doc_id", 5) != 0)
    return toxicity.score_toxicity(docs, model, held_out("doc_id", 5, 0))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", 7, 2)
    return suffix_tree.score(table(spark, sf_dir, "documents"), ~out, out)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), CONTEXT)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.group_documents(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train_quality(docs, labels, "quality", remainder("doc_id", 3) != 1)
    return quality.score_quality(docs, model, held_out("doc_id", 3, 1))


def _planted_periods(docs: DataFrame) -> DataFrame:
    """The documents' words; every tenth document, by the hash of its id, goes on in periods from some word on."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "").alias("words"),
                        number.alias("h"), F.floor(number / 10).cast("bigint").alias("g"))
    n = F.size("words").cast("bigint")
    placed = words.withColumn("n", n).withColumn("a", F.when((F.col("h") % 10 == 0) & (n > 0), (F.col("g") % F.col("n")).cast("int")))
    rest = (F.col("n") - F.col("a")).cast("int")
    period = placed.withColumn("rest", rest).withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    copies = F.ceil(F.col("rest") / F.col("p")).cast("int")
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(F.array_repeat(unit, copies)), F.lit(1), F.col("rest")))
    return period.select("doc_id", F.array_join(F.when(F.col("a").isNotNull(), planted).otherwise(F.col("words")), " ").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.detect_runs(_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.integer_vectors(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 50 == 0)


#: Control strings of a template in a text, and a backslash.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"))
    own = own.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.lit(CONTROL_TEXT).alias("text"))
    return chat.conversation_digests(chat.format_turns(turns.unionByName(own)))


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0) * 4 / greatest(1,
      ceil(4.0::DOUBLE / (1 + (length(text) - length(translate(text, '|#$%&*<>{}=~^_', '')))::DOUBLE / greatest(size, 1))))::INT AS key
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
  FROM keyed GROUP BY source),
steps AS (
  SELECT *, 3 * source_size::DOUBLE / weight AS stop,
    sum(3 * source_size) OVER w AS words, sum(weight) OVER w AS weights FROM sources
  WINDOW w AS (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST)),
levels AS (
  SELECT (t.total - s.words)::DOUBLE / (t.weights - s.weights) AS level, s.words, lead(s.stop) OVER (ORDER BY s.words, s.weights) AS next_stop
  FROM (SELECT 0 AS words, 0 AS weights, 0.0::DOUBLE AS stop UNION ALL SELECT words, weights, stop FROM steps) s,
    (SELECT sum(source_size) AS total, sum(weight) AS weights FROM sources) t
  WHERE t.weights > s.weights),
targets AS (
  SELECT source, source_size, least(weight * (SELECT coalesce(level, 0) FROM levels WHERE next_stop IS NULL OR level < next_stop ORDER BY words LIMIT 1),
    3 * source_size)::DOUBLE AS target FROM sources),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
ordered AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, floor(p.target - p.epochs * p.source_size + 0.5)::BIGINT
      - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken,
  (epochs + CASE WHEN size > 0 AND room >= size THEN 1 ELSE 0 END)::INT AS epochs,
  CASE WHEN room < size THEN greatest(0, room) ELSE 0 END::BIGINT AS part_words
FROM ordered
"""


NEGATIVES_SQL = """
WITH valid AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, c.label = a.label AS same,
    coalesce(list_sum(list_transform(generate_series(1, least(len(a.v), len(c.v))), lambda i: a.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM valid a JOIN valid c ON a.row <> c.row WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) <= 5),
found AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id NULLS LAST, n.row) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""

CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
learned AS (
  SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS LAST, role, text), '') AS loss
  FROM turns GROUP BY conv_id)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  any_value(length(loss))::BIGINT AS loss_chars, any_value(sha256(loss)) AS loss_sha256,
  sum(16 + length(replace(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<', '.lt;'), '>', '.gt;'), chr(10), '.nl;'))
    + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<', '.lt;')))::BIGINT AS formatted_chars
FROM turns t JOIN learned l ON t.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY t.conv_id
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_best_fit_packing, op2_nearest_neighbours, op3_language_id, op4_toxicity, op5_source_mixing, op6_lm_scoring, op7_token_counts,
        op8_document_fingerprints, op9_minhash_near_dedup, op10_quality_classifier, op11_periodic_runs, op12_hard_negatives,
        op13_chat_formatting)}


def oracles() -> dict[str, str]:
    return {"op5_source_mixing": MIXING_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_chat_formatting": CHAT_SQL}
