"""Dashboard, site, views and charts on small inline tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from aprlens.operators import charts, cross, dashboard, site, views
from aprlens.sources.payload import nested_text, write_nested, write_payload
from aprlens.sources.tables import read_table
from tests.conftest import rows_of

A, B, C = "1-BINANCE-BTCUSDT-31JAN2025", "2-BINANCE-BTCUSDT-28FEB2025", "3-GATE-ETHUSDT-31JAN2025"
COMPARISON = (
    "market string, market_id string, exchange string, asset string, symbol string, maturity date, date date, samples long, "
    "impliedApr double, markApr double, ammImpliedApr double, latestSettlementApr double, settlementApr double, "
    "realizedDailyApr double, realizedForwardApr double, forwardDaysUsed long, dailyBasisApr double, "
    "forwardBasisApr double, settlementSamples long"
)


def comparison(spark, day, rows):
    """Rows of (market, date, implied, realized that day, realized ahead, settled, settlement samples)."""
    out = []
    for market, date, implied, own, ahead, settled, samples in rows:
        number, venue, symbol, _ = market.split("-")
        basis = None if implied is None or ahead is None else implied - ahead
        out.append(
            (market, number, venue.title(), symbol[:3], symbol, None, day(date), 2, implied, None, None, None, settled, own,
             ahead, 0 if ahead is None else 3, None, basis, samples)
        )
    return spark.createDataFrame(out, COMPARISON)


@pytest.fixture
def small(spark, day):
    return comparison(
        spark,
        day,
        [
            (A, "2025-01-01", 0.10, 0.05, 0.04, 0.2, 3),
            (A, "2025-01-02", 0.12, 0.06, 0.05, None, None),
            (A, "2025-01-03", None, 0.07, 0.06, 0.1, 1),
            (A, "2025-01-04", 0.30, 0.07, None, 0.1, 0),
            (B, "2025-01-02", 0.20, 0.01, 0.30, 0.1, 3),
            (C, "2025-02-10", None, None, None, None, None),
        ],
    )


def test_dashboard_summary_uses_forward_rows_only(small, day):
    rows = {r.market: r for r in dashboard.market_summary(small).collect()}
    assert set(rows) == {A, B}
    a = rows[A]
    assert (a.rows, a.firstDate, a.lastDate) == (3, day("2025-01-01"), day("2025-01-03"))
    assert a.lastImpliedPct is None and a.lastRealizedForwardPct == pytest.approx(6)
    assert a.avgBasisBps == pytest.approx(650) and a.corrDaily == pytest.approx(1)
    assert rows[B].corrDaily is None


def test_heatmap_counts_each_market_once(small):
    summary = dashboard.market_summary(small)
    (row,) = dashboard.heat_intensity(dashboard.heatmap(summary)).collect()
    assert (row.exchange, row.asset, row.markets) == ("Binance", "BTC", 2)
    assert row.avgBasisBps == pytest.approx((650 - 1000) / 2) and not row.positive and row.intensity == 0.82
    assert [r.market for r in dashboard.top_markets(summary, 1).collect()] == [B]
    assert [r.market for r in dashboard.market_list(summary).collect()] == [A, B]
    assert [tuple(r)[2:4] for r in dashboard.dashboard_bounds(summary).collect()] == [(4, 2)]


def candle_rows(spark, day, rows):
    return spark.createDataFrame(
        [(m, day(d), o, 1.0, 0.0, c, v) for m, d, o, c, v in rows],
        "market string, date date, open double, high double, low double, close double, volume double",
    )


def test_site_summary(spark, small, day):
    candles = site.candle_series(
        candle_rows(spark, day, [(A, "2025-01-01", 1.0, 2.0, 5.0), (A, "2025-01-02", 1.0, 0.5, None), (B, "2025-01-01", None, 1.0, None)])
    )
    rows = {r.market: r for r in site.site_summary(site.compact_series(small), candles).collect()}
    a, b, c = rows[A], rows[B], rows[C]
    assert a.rows == 4 and a.latestImplied == 0.30 and a.latestRealizedForward is None and a.latestForwardBasis is None
    assert a.settlementSamplesPerDay == 0 and a.medianForwardBasis == pytest.approx(0.065)
    assert a.matured and a.daysToMaturity == -10 and not b.matured and b.daysToMaturity == 18
    assert (a.latestVolume, a.avgVolume, a.totalVolume) == (None, 5.0, 5.0)
    assert (b.latestVolume, b.avgVolume, b.totalVolume) == (None, None, 0.0)
    assert (c.totalVolume, c.avgForwardBasis, c.positiveBasisShare, c.settlementSamplesPerDay) == (None,) * 4
    assert b.basisVol is None and b.positiveBasisShare == 0.0
    only = site.site_summary(site.compact_series(small), candles, matured_only=True)
    assert {r.market for r in only.collect()} == {A, C}


def test_payload_nests_days_and_candles(spark, small, day, tmp_path):
    candles = site.candle_series(candle_rows(spark, day, [(A, "2025-01-02", 1.0, 2.0, 5.0), (A, "2025-01-01", 1.0, 0.5, None)]))
    series = site.compact_series(small)
    payload = site.market_payload(site.site_summary(series, candles), series, candles)
    write_payload(payload, str(tmp_path / "p"))
    back = read_table(spark, str(tmp_path / "p"), "json").orderBy("market").collect()
    assert [r.market for r in back] == [A, B, C]
    assert [d.d for d in back[0].series] == [f"2025-01-0{i}" for i in (1, 2, 3, 4)]
    assert [d.v for d in back[0].ohlcv] == [None, 5.0] and back[1].ohlcv == []
    assert back[0].summary.rows == 4


def test_streamed_payload_equals_the_nested_one(spark, small, day, tmp_path):
    rows = [(A, "2025-01-02", 1.0, 2.0, 5.0), (A, "2025-01-01", 1.0, 0.5, None), ("no-such-market", "2025-01-01", 1.0, 1.0, 1.0)]
    candles = site.candle_series(candle_rows(spark, day, rows))
    series = site.compact_series(small)
    summary = site.site_summary(series, candles)
    write_payload(site.market_payload(summary, series, candles), str(tmp_path / "p"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # pieces end inside objects
    try:
        site.write_market_payload(summary, series, candles, str(tmp_path / "q"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lines = {}
    for name in "pq":
        files = sorted((tmp_path / name).glob("part-*"))
        lines[name] = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert lines["q"] == lines["p"] and [x["market"] for x in lines["q"]] == [A, B, C]
    back = read_table(spark, str(tmp_path / "q"), "json")
    assert sorted(r.market for r in back.collect()) == [A, B, C]


def test_streamed_payload_sorts_once_and_gathers_nothing(spark, small):
    series = site.compact_series(small)
    text = nested_text(series.select("market").distinct(), {"days": series.select("market", "d", "i")}, "d")
    plan = text._jdf.queryExecution().toString().lower()
    assert "collect_list" not in plan and "rangepartitioning" in plan
    assert plan.split("== physical plan ==")[1].count("rangepartitioning") == 1


def test_streamed_payload_edges(spark, tmp_path):
    heads = spark.createDataFrame([("b", 1.0), ("a", None), (None, 2.0)], "k string, x double")
    rows = spark.createDataFrame([("b", 2, "]},\n"), ("b", None, None), ("b", 2, "]},\n"), ("z", 1, "no")], "k string, d int, t string")
    none = rows.where("false")
    write_nested(heads, {"one": none, "two": rows, "three": none}, "d", str(tmp_path / "p"))
    lines = [json.loads(x) for f in sorted((tmp_path / "p").glob("part-*")) for x in f.read_text().splitlines()]
    same = {"d": 2, "t": "]},\n"}
    assert lines == [
        {"k": None, "x": 2.0, "one": [], "two": [], "three": []},
        {"k": "a", "x": None, "one": [], "two": [], "three": []},
        {"k": "b", "x": 1.0, "one": [], "two": [{"d": None, "t": None}, same, same], "three": []},
    ]
    write_nested(heads.where("false"), {"one": rows}, "d", str(tmp_path / "q"))
    assert read_table(spark, str(tmp_path / "q"), "text").count() == 0
    with pytest.raises(Exception, match="two objects"):
        write_nested(heads.unionByName(heads), {"one": rows}, "d", str(tmp_path / "r"))
    bad = spark.createDataFrame([("b", 1, float("nan"))], "k string, d int, y double")
    with pytest.raises(Exception, match="not finite"):
        write_nested(heads, {"one": bad}, "d", str(tmp_path / "s"))


def test_candles_of_a_day_become_one(spark, day):
    d = day("2025-01-01")
    rows = [
        (A, d, 1.0, 3.0, 0.5, 2.0, 4.0, 10), (A, d, 1.0, 2.0, 0.8, 1.5, 3.0, 10),  # two states of one candle
        (A, d, 2.0, 2.5, 0.4, 2.2, None, 20), (A, d, 9.0, None, None, None, 1.0, None), (B, d, 1.0, 1.0, 1.0, 1.0, 1.0, 5),
    ]
    df = spark.createDataFrame(rows, "market string, d date, o double, h double, l double, c double, v double, at long")
    out = {r.market: tuple(r)[2:] for r in site.daily_candles(df).collect()}
    assert out == {A: (9.0, 3.0, 0.4, 2.2, 5.0, 10), B: (1.0, 1.0, 1.0, 1.0, 1.0, 5)}
    again = site.daily_candles(df.unionByName(df))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, site.daily_candles(df).collect()))
    assert site.daily_candles(df.where("false")).count() == 0


def test_payload_refuses_nan(spark, tmp_path):
    df = spark.createDataFrame([("a", [(1.0,), (float("nan"),)])], "k string, xs array<struct<x double>>")
    with pytest.raises(Exception, match="not finite"):
        write_payload(df, str(tmp_path / "p"))
    write_payload(spark.createDataFrame([("a", [(1.0,), (None,)])], df.schema), str(tmp_path / "q"))
    assert read_table(spark, str(tmp_path / "q"), "text").collect()[0][0] == '{"k":"a","xs":[{"x":1.0},{"x":null}]}'


def board(spark, rows):
    return spark.createDataFrame(rows, "market string, exchange string, asset string, maturity date, gapSum double")


def test_board_views(spark, day):
    m = day("2025-01-31")
    df = board(spark, [("a", "X", "BTC", m, 2.0), ("b", "X", "ETH", m, -3.0), ("c", "Y", "BTC", m, None)])
    assert rows_of(views.board_kpis(df)) == [(3, pytest.approx(5 / 3), 1, 1)]
    assert [r.market for r in views.rank_by_gap(df).collect()] == ["b", "a", "c"]
    assert [r.market for r in views.largest_gap(df).collect()] == ["b"]
    assert [r.market for r in views.filter_markets(df, lens="received").collect()] == ["b"]
    assert [r.market for r in views.filter_markets(df, asset="BTC", maturity="2025-01-31", lens="paid").collect()] == ["a"]
    pick = lambda **k: views.select_market(df, **k).collect()[0][0]
    assert pick(wanted="c") == "c" and pick(wanted="c", exchange="X") == "b" and pick(wanted="z", exchange="none") == "a"
    assert rows_of(views.board_kpis(views.filter_markets(df, exchange="none"))) == [(0, None, 0, 0)]
    assert rows_of(views.default_asset(df)) == [("BTC",)]
    assert rows_of(views.default_asset(df.where("asset <> 'BTC'"))) == [("ETH",)]
    assert sorted(rows_of(views.option_lists(df)))[:2] == [("asset", "BTC"), ("asset", "ETH")]


def test_settlement_difference(spark, small, day):
    out = charts.settlement_diff(site.compact_series(small).where(F.col("market") == A).withColumn("ss", F.when(F.col("ss") == 1, 3).otherwise(F.col("ss"))))
    rows = sorted(out.collect(), key=lambda r: r.d)
    assert [r.settlementsPerDay for r in rows] == [3, 3, 3, 3]
    assert [r.settlementPeriods for r in rows] == [3, 3, 3, 3]
    step = lambda i, s: (i - s) * 10000 / 365
    assert [r.cumulativeSettlementDiffBps for r in rows] == [
        pytest.approx(step(0.10, 0.2)), None, None, pytest.approx(step(0.10, 0.2) + step(0.30, 0.1)),
    ]


def test_nearest_maturity_is_stitched(spark, day):
    d, near, far = day("2025-01-01"), day("2025-01-31"), day("2025-02-28")
    rows = [
        ("BTC", "X", d, near, None), ("BTC", "X", d, far, 0.4), ("BTC", "Y", d, near, 0.1), ("BTC", "Y", d, near, 0.3),
        ("BTC", "Y", d, far, 9.0), ("ETH", "Z", d, far, 1.0),
    ]
    df = spark.createDataFrame(rows, "asset string, exchange string, d date, maturity date, i double")
    stitched = cross.cross_exchange(df)
    assert sorted(rows_of(stitched, "exchange", "implied")) == [("X", 0.4), ("Y", pytest.approx(0.2)), ("Z", 1.0)]
    wide = cross.cross_exchange_wide(stitched, "BTC", ["Z", "Y", "X"])
    assert wide.columns == ["d", "X", "Y", "Z"] and rows_of(wide) == [(d, 0.4, pytest.approx(0.2), None)]
    with pytest.raises(Exception, match="not in the list: Y"):
        cross.cross_exchange_wide(stitched, "BTC", ["X"]).collect()
    maps = {r.asset: r.implied for r in cross.cross_exchange_map(stitched).collect()}
    assert maps == {"BTC": {"X": 0.4, "Y": pytest.approx(0.2)}, "ETH": {"Z": 1.0}}


def test_exchanges_come_from_the_markets(spark):
    names = ["1-BINANCE-BTCUSDT-31JAN2025", "2-FOO_dex-BTCUSDT-31JAN2025", "3-OKX-ETHUSDT-31JAN2025", "odd", "4-FOO_dex-BTC-28FEB2025"]
    markets = spark.createDataFrame([(n,) for n in names], "market string")
    assert cross.exchanges_of(markets, "BTC") == ["Binance", "Foo_Dex"]


def test_domain_and_histogram(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 2.0), ("c", None)], "k string, x double")
    got = {r.k: (r.lo, r.hi) for r in charts.padded_domain(df, [F.col("x")], ["k"]).collect()}
    assert got == {"a": pytest.approx((0.84, 3.16)), "b": pytest.approx((0.84, 3.16)), "c": (0.0, 1.0)}
    counts = charts.histogram(df, F.col("x")).collect()
    assert len(counts) == 18 and sum(r.days for r in counts) == 3
    by_key = charts.histogram(df, F.col("x"), ["k"]).groupBy("k").agg(F.count("bucket"), F.sum("days"))
    assert sorted(rows_of(by_key)) == [("a", 18, 2), ("b", 18, 1), ("c", 18, 0)]
    nulls = charts.histogram(df.withColumn("k", F.nullif("k", F.lit("a"))), F.col("x"), ["k"]).groupBy("k").agg(F.sum("days"))
    assert dict(rows_of(nulls)) == {None: 2, "b": 1, "c": 0}


def test_candles(spark, day):
    rows = [(A, "2025-01-01", 1.0, 1.0, 4.0), (A, "2025-01-02", 2.0, 1.0, None), (B, "2025-01-01", None, 1.0, 0.5)]
    out = charts.candles(site.candle_series(candle_rows(spark, day, rows)))
    assert sorted(rows_of(out, "market", "d", "up", "volumeShare")) == [
        (A, day("2025-01-01"), True, 1.0), (A, day("2025-01-02"), False, None), (B, day("2025-01-01"), None, 0.5),
    ]
