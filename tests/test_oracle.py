"""Every registered query at the smallest scale, next to its SQL where there is one."""

from __future__ import annotations

import __spark_entry__ as registry
import pytest
from compare import compare, connect

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = registry.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    assert compare(spark, con, name, sf, QUERIES[name], ORACLES.get(name)) is None
