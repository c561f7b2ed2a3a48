import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Corpus lines from a list of strings."""

    def make(texts, partitions=2):
        rows = [(i, text) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "line_key INT, line STRING").repartitionByRange(partitions, "line_key")

    return make


@pytest.fixture
def vocab(spark):
    """A vocabulary of given words in order."""

    def make(words):
        rows = [(i, w, 1) for i, w in enumerate(words, 1)]
        return spark.createDataFrame(rows, "id INT, word STRING, count BIGINT")

    return make
