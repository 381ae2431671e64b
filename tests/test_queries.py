"""Every query runs; those with SQL give the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from narrata import plans
from tests.oracle import assert_same, connect

plans.load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    if name in plans.ORACLE:
        assert_same(df, con, plans.ORACLE[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["word", "total", "unknown"]
