import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def own_random_numbers(request):
    """The same data for a test whatever runs before it."""
    random.seed(request.node.nodeid.split("/")[-1])


@pytest.fixture
def docs(spark):
    """Documents with columns whose names the operators use themselves."""

    def make(texts, ids=None):
        rows = [(i, t, "x", 7, None) for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, id STRING, n INT, th BIGINT").withColumn("n_chars", F.lit(1).cast("bigint"))

    return make


@pytest.fixture
def rows():
    """Rows of a result by id, a list for each."""

    def make(df, key="doc_id"):
        found = {}
        for row in df.collect():
            found.setdefault(row[key], []).append(row)
        return found

    return make
