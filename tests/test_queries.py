"""Every registered query against its SQL on the smallest tables, and the registry's shape."""

from __future__ import annotations

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from aprlens.bindings.queries import REGISTRY
from tests.check_oracle import compare, connect

WIDER_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_DIR)


def test_every_query_has_its_sql():
    assert set(REGISTRY) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[:2] == ["market", "market_id"]


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_its_sql(spark, con, name):
    if name == "cross_exchange_wide":  # its columns are the exchanges there are, which the SQL has to name
        left, right, _ = compare(spark, connect(WIDER_DIR), name, WIDER_DIR)
    else:
        left, right, _ = compare(spark, con, name, SMOKE_DIR)
    assert not left and not right
