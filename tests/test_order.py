"""Order of the ranked results, which the hash of a set of rows does not see."""

from __future__ import annotations

import pytest

from __spark_entry__ import SMOKE_DIR, oracle_sql, queries
from tests.check_oracle import connect

ORDERS = {
    "gap_rank": "gapSize DESC, market",
    "filtered_markets": "abs(coalesce(gapSum, 0)) DESC, market",
    "lens_paid": "abs(coalesce(gapSum, 0)) DESC, market",
    "market_summary": "abs(coalesce(avgBasisBps, 0)) DESC, market",
    "market_list": "rows DESC, abs(coalesce(avgBasisBps, 0)) DESC, market",
    "market_summary_top24": "abs(coalesce(avgBasisBps, 0)) DESC, market",
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_the_order_of_the_sql(spark, name):
    found = [r["market"] for r in queries()[name](spark, SMOKE_DIR).collect()]
    ranked = connect(SMOKE_DIR).execute(f"SELECT market FROM ({oracle_sql()[name]}) ORDER BY {ORDERS[name]}").fetchall()
    assert found == [r[0] for r in ranked]
