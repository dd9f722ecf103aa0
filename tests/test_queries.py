import pytest

from millrace import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    oracle.same(spark, con, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, oracle.SF).count() > 0


def test_functions_see_all_events(spark):
    from millrace.model import events

    assert catalog.QUERIES["sql_functions_all"](spark, oracle.SF).count() == events(spark, oracle.SF).count()
