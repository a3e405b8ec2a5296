"""Every registered core query against its SQL over the smallest tables."""

import pytest

from gridquill.plans.oracles import ORACLES
from gridquill.plans.queries import QUERIES
from support import DATA, duck, rows, sql_rows


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    assert rows(df) == sql_rows(con, ORACLES[name], sorted(df.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
