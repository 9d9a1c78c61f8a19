"""Territory queries against their SQL at the smallest size; those without SQL must run and give rows."""

import pytest

from terrafold.plans import registry
from tests.conftest import SF

#: Some queries need more rows than the smallest tables have.
LARGER = "/root/testdata/sf0.01"

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(agree, name):
    agree(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, LARGER).limit(1).count() == 1
