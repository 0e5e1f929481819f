"""Every registered query of the library gives the rows of its SQL twin."""

import pytest

import __spark_entry__
from chatterlake.plans.registry import REGISTERED, SQL
from tests.oracle import connection, difference

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(REGISTERED)


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_query_with_sql_is_compared():
    assert set(REGISTERED) <= set(__spark_entry__.queries()) and set(SQL) == set(NAMES)
    assert {n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline"} == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    assert difference(REGISTERED[name](spark, FOLDER), con, SQL[name]) == ""
