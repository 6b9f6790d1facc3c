"""Every registered query against its SQL on the small tables; queries without SQL must give rows."""

from __future__ import annotations

import pytest
from oracle import SF, differs, views

import __spark_entry__ as entry
from farfield.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    c = views(SF)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, con, name):
    assert not differs(spark, con, name, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
