import pytest

from siltworks.llm import queries
from tests.compare import assert_same, connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLES[name])


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
