"""Tables of texts seen as projects of files: ``project, rel_path, content`` and their facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions.content import is_binary


def entries_from(rows: DataFrame, project: Column, rel_path: Column, content: Column) -> DataFrame:
    """Entries of a table whose rows are files; texts in a table are valid UTF-8 already."""
    return rows.select(project.alias("project"), rel_path.alias("rel_path"), content.alias("content")).withColumns({
        "is_dir": F.lit(False), "is_file": F.lit(True),
        "length": F.octet_length("content").cast("bigint"),
        "is_binary": is_binary(F.col("content")), "lossy_utf8": F.lit(False),
    })


def spread(rows: DataFrame) -> DataFrame:
    """Give a table that comes in fewer pieces than there are cores to every core, before heavy work on texts."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(number: Column, *values: str) -> Column:
    """One of the values by the number's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per source; ``lang/doc_id.ext``."""
    ext = pick(F.col("doc_id"), ".txt", ".md", ".log", ".pem")
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return entries_from(table(spark, sf_dir, "documents"), F.col("source"), path, F.col("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per host; the URL's path below the page id, ``index.html`` where it names no file."""
    tail = F.regexp_extract("url", r"^https?://[^/?#]+/?([^?#]*)", 1)
    tail = F.when((tail == "") | tail.endswith("/"), F.concat(tail, F.lit("index.html"))).otherwise(tail)
    return entries_from(
        table(spark, sf_dir, "pages"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1),
        F.concat(F.col("page_id").cast("string"), F.lit("/"), tail), F.col("html"))
