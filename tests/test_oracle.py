"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import oracle
import pytest
from conftest import DATA

from chatspark.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, DATA), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0
