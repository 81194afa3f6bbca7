"""A run on files that arrive as a stream: framed blocks as they come, and running counts per project.

Rules, size, byte checks and framing look at one file at a time and hold no state, so they run
unchanged on a streaming DataFrame.  Trees and ignore files look at whole projects and belong to a
batch run over the files collected so far.

``Arrivals`` adds every arriving file's decision, tokens and block to a table below a folder, one part
per micro-batch, and the part's counts per project to another; texts are read once.  A part is written under the number of its batch and
replaces what a failed attempt of the same batch left, so a stream that is stopped or fails at any
point goes on without losing or repeating a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packloom.functions.content import estimated_tokens, frame
from packloom.operators.config import ScanConfig
from packloom.operators.decide import SKIPPED, decide
from packloom.operators.render import block_tokens, blocks, included

_COUNTS = ("files_processed", "files_skipped", "block_tokens")


def decide_arrivals(entries: DataFrame, config: ScanConfig) -> DataFrame:
    return decide(entries, config.rules())


def frame_arrivals(entries: DataFrame, config: ScanConfig) -> DataFrame:
    """``project, rel_path, value`` of every arriving file that the rules and checks let in."""
    return blocks(decide_arrivals(entries, config).where(included("content")))


def taken_files(entries: DataFrame, config: ScanConfig, tokens=estimated_tokens) -> DataFrame:
    """``project, rel_path, code, skipped, block_tokens, value`` of arriving files; the last two of those let in."""
    inside = included("content")
    cost = block_tokens(F.col("rel_path"), tokens(F.col("content")), tokens)
    return decide_arrivals(entries, config).select(
        "project", "rel_path", F.col("content_code").alias("code"), (F.col("content_code").isin(*SKIPPED) & ~F.col("is_dir")).alias("skipped"),
        F.when(inside, cost).alias("block_tokens"), F.when(inside, frame(F.col("rel_path"), F.col("content"))).alias("value"))


def count_files(taken: DataFrame) -> DataFrame:
    """``project`` and its counts over taken files, whose texts are not looked at."""
    return taken.groupBy("project").agg(
        F.count("block_tokens").alias("files_processed"), F.count_if("skipped").alias("files_skipped"),
        F.coalesce(F.sum("block_tokens"), F.lit(0)).cast("bigint").alias("block_tokens"))


class Arrivals:
    """Blocks and counts of a stream of entries, in ``files``, ``counts`` and ``state`` below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, config: ScanConfig, tokens=estimated_tokens):
        self.spark, self.folder, self.config, self.tokens = spark, folder, config, tokens

    def start(self, entries: DataFrame) -> StreamingQuery:
        """Take in all that has arrived, in one or more micro-batches, and stop; start again to go on from there."""
        return (
            entries.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/state")
            .foreachBatch(self._take).start())

    def _take(self, batch: DataFrame, number: int) -> None:
        part, taken = f"{self.folder}/files/batch={number}", taken_files(batch, self.config, self.tokens)
        taken.write.mode("overwrite").parquet(part)
        written = batch.sparkSession.read.schema(taken.schema).parquet(part)
        count_files(written).write.mode("overwrite").parquet(f"{self.folder}/counts/batch={number}")

    def blocks(self) -> DataFrame:
        """``project, rel_path, value`` of all files taken in and let in."""
        found = self.spark.read.schema("project string, rel_path string, value string, batch bigint").parquet(f"{self.folder}/files")
        return found.where("value is not null").drop("batch")

    def counts(self) -> DataFrame:
        """``project, files_processed, files_skipped, block_tokens`` of all files taken in.

        Every batch left one row per project, so this sums small rows, whatever the texts' size.
        """
        rows = self.spark.read.schema("project string, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", batch bigint").parquet(f"{self.folder}/counts")
        return rows.groupBy("project").agg(*[F.sum(c).alias(c) for c in _COUNTS])
