"""Every registered query against its SQL, whole results, at sf0.01."""

import pytest
from conftest import SF_DIR
from oracle_check import compare, connect

import __spark_entry__ as entry_module
from netlens.plans.catalog import QUERIES
from netlens.plans.oracle import ORACLE_SQL as SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, difference = compare(spark, con, QUERIES[name], SQL[name], SF_DIR)
    assert difference is None
    assert rows > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "packet_id"
    assert df.count() == 362
