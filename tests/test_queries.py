"""Every registered query against its SQL on the smallest test tables."""

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = f"{oracle.ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.compare(df, con, sql) is None


def test_entry(spark):
    assert len(entry(spark).collect()) == 10


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
