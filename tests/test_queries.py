import os

import pytest

import check_queries as check
from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return check.connection(SF)


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, duck, name):
    assert check.compare(queries()[name](spark, SF).toPandas(), duck.sql(oracle_sql()[name]).df()) == "ok"


def test_singular_values_fall(spark):
    values = [r["value"] for r in queries()["svd_singular_values"](spark, SF).orderBy("rank").collect()]
    assert len(values) == 50 and values == sorted(values, reverse=True) and values[-1] > 0
