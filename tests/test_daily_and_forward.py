"""Daily tables, forward averages and the comparison."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from aprlens.operators import compare, daily, forward
from tests.conftest import rows_of

NAN, INF = float("nan"), float("inf")
M = "1-BINANCE-BTCUSDT-31JAN2025"
SNAPSHOT = "market string, date date, midApr double, markApr double, ammImpliedApr string, latestSettlementApr double, notionalOI double"


def snapshots(spark, rows):
    return spark.createDataFrame([(m, d, mid, mark, "x", None, 1.0) for m, d, mid, mark in rows], SNAPSHOT)


def funding(spark, rows):
    return spark.createDataFrame(rows, "exchange string, asset string, date date, annualizedFundingRate double")


def settled(spark, rows):
    return spark.createDataFrame(rows, "market string, date date, settlementApr double")


def test_market_daily_counts_all_rows_and_falls_back_after_averaging(spark, day):
    d = day("2025-01-01")
    table = daily.market_daily(snapshots(spark, [(M, d, None, 0.1), (M, d, 0.04, 0.2), ("weird", d, NAN, INF)]))
    rows = {r.market: r for r in table.collect()}
    assert (rows[M].samples, rows[M].midApr, rows[M].ammImpliedApr) == (2, 0.04, None)
    assert (rows["weird"].samples, rows["weird"].midApr, rows["weird"].exchange) == (1, None, None)
    out = compare.apr_comparison(table, daily.underlying_daily(funding(spark, [])), daily.settlement_daily(settled(spark, [])))
    implied = {r.market: r.impliedApr for r in out.collect()}
    assert implied == {M: 0.04, "weird": None}


def test_underlying_daily_counts_numbers_only(spark, day):
    a, b, c = day("2025-01-01"), day("2025-01-02"), day("2025-01-03")
    rows = [("Gate", "BTC", a, None), ("Gate", "BTC", a, NAN), ("Gate", "BTC", a, 0.1), ("Gate", "BTC", b, None), ("Gate", "BTC", c, NAN)]
    got = sorted(rows_of(daily.underlying_daily(funding(spark, rows)), "date", "samples", "realizedApr"))
    assert got == [(a, 2, 0.1), (c, 1, None)]


def intervals(spark, rates, rows, as_of="2025-12-31"):
    under = spark.createDataFrame(rates, "exchange string, asset string, date date, realizedApr double")
    asked = spark.createDataFrame(rows, "id int, exchange string, asset string, date date, maturity date")
    out = compare.with_daily_realized(forward.with_forward_average(asked, under, as_of), under)
    return {r.id: (r.realizedForwardApr, r.forwardDaysUsed, r.realizedDailyApr) for r in out.collect()}


def test_forward_windows(spark, day):
    rates = [("G", "B", day("2025-01-01"), 1.0), ("G", "B", day("2025-01-05"), 3.0), ("G", "B", day("2025-01-03"), None)]
    asked = [
        (1, "G", "B", day("2025-01-02"), day("2025-01-04")),
        (2, "G", "B", day("2025-01-01"), day("2025-01-05")),
        (3, "G", "B", day("2024-11-01"), day("2024-12-31")),
        (4, "G", "B", day("2025-02-01"), day("2025-03-01")),
        (5, "G", "B", day("2024-12-01"), day("2025-06-01")),
        (6, "G", "B", day("2025-01-05"), day("2025-01-01")),
        (7, "G", "B", day("2025-01-01"), None),
        (8, "X", "B", day("2025-01-01"), day("2025-01-05")),
        (9, "G", "B", day("2025-01-31"), day("2025-02-01")),
    ]
    nothing = (None, 0, None)
    assert intervals(spark, rates, asked) == {
        1: nothing, 2: (2.0, 2, 1.0), 3: nothing, 4: nothing, 5: (2.0, 2, None), 6: (None, 0, 3.0), 7: (None, 0, 1.0),
        8: nothing, 9: nothing,
    }
    assert intervals(spark, rates, asked[1:2], "2025-01-04") == {2: (1.0, 1, 1.0)}
    assert intervals(spark, rates, [(1, "G", "B", day("2025-01-05"), day("2025-06-01"))], "2025-01-04") == {1: (None, 0, 3.0)}


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_forward_average_equals_brute_force(spark, broadcast):
    rng = random.Random(7)
    start = dt.date(2023, 12, 1)
    rates = {}
    for pair in (("G", "B"), ("G", "E"), ("O", "B")):
        for _ in range(120):
            rates[(*pair, start + dt.timedelta(rng.randrange(0, 420)))] = rng.random()
    asked = []
    for i in range(600):
        pair = rng.choice([("G", "B"), ("G", "E"), ("O", "B"), ("N", "N")])
        begin = start + dt.timedelta(rng.randrange(-60, 500))
        asked.append((i, *pair, begin, begin + dt.timedelta(rng.randrange(-5, 200))))
    as_of = dt.date(2025, 1, 10)
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = intervals(spark, [(*k, v) for k, v in rates.items()], asked, as_of)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)
    for i, exchange, asset, begin, maturity in asked:
        end = min(maturity, as_of)
        inside = [v for (e, a, d), v in rates.items() if (e, a) == (exchange, asset) and begin <= d <= end]
        mean, days, own = got[i]
        assert days == len(inside)
        assert mean == (pytest.approx(sum(inside) / len(inside)) if inside else None)
        assert own == rates.get((exchange, asset, begin))


def test_comparison_keeps_every_market_day(spark, day):
    d1, d2 = day("2025-01-01"), day("2025-01-02")
    market = daily.market_daily(snapshots(spark, [(M, d1, 0.3, None), (M, d2, None, None)]))
    under = daily.underlying_daily(funding(spark, [("Binance", "BTC", d1, 0.1), ("Binance", "BTC", d2, 0.2)]))
    settle = daily.settlement_daily(settled(spark, [(M, d1, 0.5), (M, d1, NAN)]))
    out = compare.comparison_with_samples(market, under, settle, "2025-06-01")
    columns = ["date", "impliedApr", "realizedDailyApr", "realizedForwardApr", "forwardDaysUsed", "dailyBasisApr",
               "forwardBasisApr", "settlementApr", "settlementSamples"]
    first, second = sorted(rows_of(out, *columns))
    assert first == (d1, 0.3, 0.1, pytest.approx(0.15), 2, pytest.approx(0.2), pytest.approx(0.15), 0.5, 2)
    assert second == (d2, None, 0.2, pytest.approx(0.2), 1, None, None, None, None)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_has_no_range_join_and_no_python(spark, day):
    from __spark_entry__ import SMOKE_DIR, queries

    for threshold in ("-1", "10MB"):
        default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            plan = plan_of(queries()["apr_comparison"](spark, SMOKE_DIR))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)
        for node in ("NestedLoop", "Cartesian", "Python", "MapIn"):
            assert node not in plan
        assert "l_extendedprice" not in plan and "l_quantity" not in plan


def test_pages_are_built_once(spark):
    """In the plan that ran, the second look-up reuses what the first one sent."""
    keys = "market string, market_id string, exchange string, asset string, symbol string, maturity date, date date"
    values = "samples long, midApr double, markApr double, ammImpliedApr double, latestSettlementApr double, notionalOI double"
    d = dt.date(2025, 1, 1)
    market = spark.createDataFrame([("m", "1", "X", "BTC", "S", dt.date(2025, 3, 1), d, 1, 0.1, 0.1, 0.1, 0.1, 1.0)], f"{keys}, {values}")
    under = spark.createDataFrame([("X", "BTC", d, 1, 0.2)], "exchange string, asset string, date date, samples long, realizedApr double")
    settled = spark.createDataFrame([("m", d, 0.1, 1)], "market string, date date, settlementApr double, samples long")
    out = compare.comparison_with_samples(market, under, settled, "2025-06-30")
    assert out.collect()[0].realizedForwardApr == pytest.approx(0.2)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Generate explode(sequence(") == 1 and "ReusedExchange" in plan
