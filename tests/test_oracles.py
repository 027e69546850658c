import pytest

from clustrum.plans.oracles import oracle_sql
from clustrum.plans.queries import queries

from .checks import agree, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_sql(spark, sf, con, name):
    agree(queries()[name](spark, sf), oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_has_rows(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0
