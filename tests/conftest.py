import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("corpusloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus_of(spark):
    """Build a corpus (path, content, size) from a dict or a list of pairs."""

    def build(files):
        rows = list(files.items()) if isinstance(files, dict) else list(files)
        df = spark.createDataFrame(rows, "path string, content string")
        return df.withColumn("size", F.octet_length("content").cast("bigint"))

    return build


@pytest.fixture(scope="session")
def rewritten_of(corpus_of):
    """Contents by path after admission and rules."""
    from corpusloom.operators.admit import admit
    from corpusloom.operators.rules import DEFAULT_RULES, rewrite

    def run(files, rules=DEFAULT_RULES, **options):
        done = rewrite(admit(corpus_of(files)), rules, **options)
        return {r["path"]: r["content"] for r in done.collect()}

    return run
