import pytest

from lectern.plans import catalogue, readers, register  # noqa: F401 - the modules register their queries
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(register.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, register.QUERIES[name], register.ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(register.QUERIES) - set(register.ORACLES)))
def test_other_queries_run(spark, name):
    assert register.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
