"""Every named query against its SQL counterpart on DuckDB."""

import pytest

import __spark_entry__ as contract
from broadsheet.plans.registry import QUERIES
from tools.compare import connection, difference

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


def test_every_query_has_sql():
    assert set(NAMES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = contract.queries()[name](spark, sf_dir)
    rows = df.collect()
    cursor = duck.execute(contract.oracle_sql()[name])
    problem = difference(df.columns, rows, [d[0] for d in cursor.description], cursor.fetchall())
    assert problem is None, problem


def test_entry(spark):
    assert contract.entry(spark).count() > 0
