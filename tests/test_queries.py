"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as spec

QUERIES, SQL = spec.queries(), spec.oracle_sql()


@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, tables, name):
    problem = difference(spark, con, QUERIES[name], SQL.get(name), tables)
    # Some patterns and slices match nothing in the smallest tables.
    assert problem in (None, "no rows")


def test_entry(spark):
    assert spec.entry(spark).count() == 4
    assert set(SQL) <= set(QUERIES)
