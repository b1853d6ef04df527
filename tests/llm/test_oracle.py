import pytest

from tests.oracle import connect, same
from tidemill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLES[name], sf_dir)
