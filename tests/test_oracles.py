"""Every registered query with an SQL counterpart, compared row by row on the small tables."""

import pytest
from harness import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    ok, message = compare(entry.queries()[name](spark, SF), con, ORACLES[name])
    assert ok, message


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and max(r.segment_rank for r in rows) <= 50
