"""Every core query against its oracle SQL on the smallest tables; those without SQL give rows here and are
compared with plain Python in test_values.py and in the tests of their operators."""

import pytest

from loomgraph.plans import registry
from tests.compare import check

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, name):
    check(spark, name, QUERIES[name], sf, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
