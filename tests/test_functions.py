"""One test per rule on numbers, names and dates."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from aprlens.functions import markets as mk, numeric as nm, rates, timing as tm
from tests.conftest import rows_of

NAN, INF = float("nan"), float("inf")


def doubles(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def one(df, *columns):
    return df.agg(*columns).collect()[0]


def test_finite_mean_skips_what_is_no_number(spark):
    assert one(doubles(spark, [1.0, NAN, INF, None]), nm.finite_mean(F.col("x")))[0] == 1.0
    assert one(doubles(spark, [NAN, None]), nm.finite_mean(F.col("x")))[0] is None


def test_permissive_double(spark):
    cases = {
        "": None, " 2 ": 2.0, "1_000": 1000.0, "1.5d": None, "1.5f": None, "abc": None, "1__0": None, "_1": None,
        "0x1p3": None, "1.": 1.0, ".5": 0.5, "+3": 3.0, "-4e-1": -0.4, "1e+5": 1e5, "1 2": None, "-Infinity": -INF,
        "inf": INF, "true": None,
    }
    df = spark.createDataFrame([(k,) for k in [*cases, "nan", "NaN"]], "t string")
    got = {r.t: r.v for r in df.select("t", nm.permissive_double(F.col("t")).alias("v")).collect()}
    assert all(math.isnan(got.pop(word)) for word in ("nan", "NaN"))
    assert got == cases


def test_finite_double_drops_words(spark):
    df = spark.createDataFrame([("nan",), ("inf",), ("0.5",), (None,)], "t string")
    assert [r[0] for r in df.select(nm.finite_double(F.col("t"))).collect()] == [None, None, 0.5, None]


@pytest.mark.parametrize(
    "pairs, expected",
    [
        ([(1.0, 1.0), (1.0, 2.0)], None),
        ([(1.0, 1.0)], None),
        ([(1.0, 1.0), (2.0, None), (3.0, 3.0), (NAN, 9.0)], 1.0),
        ([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)], -1.0),
    ],
)
def test_pearson(spark, pairs, expected):
    df = spark.createDataFrame(pairs, "x double, y double")
    got = one(df, nm.pearson(F.col("x"), F.col("y")))[0]
    assert got is None if expected is None else got == pytest.approx(expected)


def test_spread_and_quantiles(spark):
    row = one(doubles(spark, [5.0, NAN]), nm.spread(F.col("x")), nm.quantiles(F.col("x"), [0.1]))
    assert row[0] is None and row[1] == [5.0]
    row = one(doubles(spark, [9.0, 1.0, 4.0, 2.0]), nm.spread(F.col("x")), nm.quantiles(F.col("x"), [0.1, 0.5]))
    assert row[0] == pytest.approx(3.0822, abs=1e-4) and row[1] == pytest.approx([1.3, 3.0])


def test_mode_and_positive_share(spark):
    df = spark.createDataFrame([(v,) for v in (3, 3, 1, 1, 7, None)], "x long")
    assert one(df, nm.smallest_mode(F.col("x")))[0] == 1
    assert one(doubles(spark, [0.0, 0.1, -0.1, None]), nm.positive_share(F.col("x")))[0] == pytest.approx(1 / 3)


def test_market_names(spark, day):
    names = ["weird", "12-BINANCE-BTC-USDT-26DEC2025", "7-FOO_BAR1X-xyzGOLD-01JAN2026", "1-KUCOIN-PEPEUSDT-31FEB2025"]
    df = mk.with_market_columns(spark.createDataFrame([(n,) for n in names], "market string"))
    got = {r[0]: r[1:] for r in rows_of(df, "market", *mk.MARKET_COLUMNS)}
    assert got["weird"] == (None,) * 6
    assert got[names[1]] == ("12", "BINANCE", "Binance", "BTC-USDT", "BTC-", day("2025-12-26"))
    assert got[names[2]] == ("7", "FOO_BAR1X", "Foo_Bar1X", "xyzGOLD", "XAU", day("2026-01-01"))
    assert got[names[3]] == ("1", "KUCOIN", "KuCoin", "PEPEUSDT", "PEPE", None)


def test_assets(spark):
    cases = {"xyzGOLD": "XAU", "CLUSDT": "CLOIL", "PEPEUSDT": "PEPE", "XYZ100": "XYZ100", "xyzXYZ100": "XYZ100",
             "sp500": "S&P500", "btcusdt": "BTC", "DOGE": "DOGE"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert dict(rows_of(df.selectExpr("s", mk.asset_of_symbol("s")))) == cases


def test_funding_names(spark):
    df = spark.createDataFrame([("Binance-btc-x",), ("Gate-gold",), ("nodash",)], "s string")
    got = rows_of(df.selectExpr(mk.funding_exchange("s"), mk.funding_asset("s")))
    assert got == [("Binance", "BTC-X"), ("Gate", "XAU"), (None, None)]


def test_epoch_fields_do_not_depend_on_the_session_zone(spark, day):
    df = spark.createDataFrame([("", 1735689600), (None, -1), ("given", 1741503599)], "t string, s long")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = rows_of(df.select(tm.utc_date(F.col("s")), tm.iso_utc(F.col("s")), tm.datetime_or_iso(F.col("t"), F.col("s"))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [
        (day("2025-01-01"), "2025-01-01T00:00:00+00:00", "2025-01-01T00:00:00+00:00"),
        (day("1969-12-31"), "1969-12-31T23:59:59+00:00", "1969-12-31T23:59:59+00:00"),
        (day("2025-03-09"), "2025-03-09T06:59:59+00:00", "given"),
    ]


def test_days_between(spark):
    df = spark.range(1).select(tm.days_between(F.lit(dt.date(2025, 3, 1)), F.lit(dt.date(2025, 2, 27))))
    assert rows_of(df) == [(-2,)]


def test_rate_scaling_and_labels(spark):
    df = spark.createDataFrame([(0.365, 1), (0.365, 0), (None, 3), (0.1, None)], "apr double, n long")
    got = [r[0] for r in df.select(rates.funding_bps(F.col("apr"), F.col("n"))).collect()]
    assert got == [pytest.approx(10.0), None, None, None]
    df = doubles(spark, [None, 0.0004, 0.0005, -0.2])
    assert rows_of(df.select(rates.gap_label(F.col("x")), rates.gap_class(F.col("x")))) == [
        ("Insufficient data", "neutral"),
        ("Near realized", "neutral"),
        ("Paid more than realized", "positive-gap"),
        ("Received more than paid", "negative-gap"),
    ]


def test_rounded_text_is_round(spark):
    rng = random.Random(5)
    sizes = [rng.choice([1e-9, 1e-6, 1e-3, 1.0, 1e3, 1e5, 1e6, 1e7, 1e13, 1e300]) for _ in range(20000)]
    values = [rng.uniform(-1, 1) * s for s in sizes] + [rng.randrange(-(10**9), 10**9) / 2e6 for _ in range(20000)]
    values += [None, NAN, INF, -INF, -0.0, 0.0, 5e-7, 1.0000005, 2.5e-6, 999999.9999995, 1e6]
    df = doubles(spark, values)
    differ = df.where(~F.expr(f"{nm.rounded_text('x')} <=> round(x, 6)"))
    assert differ.count() == 0


def test_columns_of_a_market_name_are_finished_before_the_generator(spark):
    """Inside a generator nothing is compiled, and every line of an archive of one line pays for that."""
    names = spark.createDataFrame([("7-NOVA_dex2x-xyzGOLD-29MAR2024",)], "market string")
    made = mk.with_market_columns(names)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in plan.split("\n") if "Generate explode" in line]
    assert generators and not any("element_at" in line for line in generators)
    assert made.first()["exchange"] == "Nova_Dex2X"
