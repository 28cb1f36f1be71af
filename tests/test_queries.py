"""Every query with an oracle gives the rows of its SQL."""

import pytest

from finloom.plans import registry
from tests.compare import engine, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return engine(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    same(spark, con, sf_dir, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() >= 0
