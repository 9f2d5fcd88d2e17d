"""Every registered query next to its DuckDB oracle on the smallest tables
(the round driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_check import check, duck

NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = check(spark, con, SF001, name, E.queries()[name], E.oracle_sql().get(name))
    assert r["status"] in ("OK", "rows-only"), r
