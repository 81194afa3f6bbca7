import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def entries(spark):
    """Entries of one project from ``{path: text}``; a path ending in ``/`` is a directory."""

    def make(files, project="p"):
        rows = [(project, path.rstrip("/"), None if path.endswith("/") else text, path.endswith("/"),
                 None if path.endswith("/") else len(text.encode())) for path, text in files.items()]
        table = spark.createDataFrame(
            rows, "project string, rel_path string, content string, is_dir boolean, length bigint")
        return table.selectExpr("*", "not is_dir as is_file")

    return make
