"""Every relational query against its SQL on the smallest tables."""

import oracle
import pytest

from panelmill.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert oracle.difference(registry.queries()[name](spark, sf), con, SQL[name]) == ""
