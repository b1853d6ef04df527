import pytest

from tests.oracle import connect, same
from tidemill import plans
from tidemill.plans import registry

plans.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    same(spark, con, registry.QUERIES[name], registry.ORACLES[name], sf_dir)
