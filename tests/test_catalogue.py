"""Every catalogue query against its SQL on a second engine, and what their plans must not hold."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from tallymill.plans import catalogue, oracle_sql

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = catalogue.queries()
ORACLES = oracle_sql.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_they_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    text = plan(df)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text, operator
    assert differences(df, duck, ORACLES[name]) == []
