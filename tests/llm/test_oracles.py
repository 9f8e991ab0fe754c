import pytest

from lectern.llm import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", registry.QUERIES[name], registry.ORACLES[name]) >= 0
