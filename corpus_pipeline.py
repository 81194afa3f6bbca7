"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, mixture, packing.

Every stage takes the documents its predecessor kept and works on all of them; all but the last
return the columns of documents.  Rows without an id are judged, grouped, mixed and packed by their
text like others, and repeated rows are rows of their own.  An empty table passes through as an
empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm import minhash, mixing, packing, quality, toxicity
from packloom.llm.common import table, written
from packloom.operators.joins import unique_join
from packloom.operators.saving import saved

SHINGLE, PERCENT = 5, 80
VOCABULARY, CONTEXT = "word_bpe_49k.json", 2048


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are likelier good than not, as ``labels.quality`` marks them."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.score(F.col("text")) >= 0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are as likely toxic as not, or likelier, as ``labels.toxic`` marks them.

    A model that learned nothing tells no document from another, and none is dropped.
    """
    model = toxicity.train_ftrl(docs, table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs
    return docs.where(toxicity.score_column(spark, model, "text") < 0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: that with the smallest id, ids before none.

    Rows are told apart by a number that is written once, so a repeated id or none loses no text
    and leaves no copy.  A text without words is nobody's duplicate.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), "_row")
    groups = minhash.group_documents(rows, SHINGLE, PERCENT, doc_id="_row").select(F.col("doc_id").alias("_row"), "component_id")
    members = written(groups.join(rows.select("_row", order.alias("order")), "_row"))
    first = members.groupBy("component_id").agg(F.min("order").alias("first")).select("first._row")
    extra = saved(members.select("_row").join(first, "_row", "left_anti"))
    return unique_join(rows, extra, ["_row"], "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as it takes them, and in part where a source's budget ends."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, copies included, and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), CONTEXT)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express trained classifiers and a vocabulary's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
