import pytest

from millrace.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    oracle.same(spark, oracle.connection(), queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, oracle.SF).count() > 0
