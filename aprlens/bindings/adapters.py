"""Test tables seen as market snapshots, funding rates, settlements and candles.

``l_suppkey`` and ``o_custkey`` choose one of 40 venue and symbol combinations. Rates are divided by primes
so that no average falls on a rounding tie. ``oracle.py`` holds the same views as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.markets import asset_of_symbol, exchange_name

AS_OF = "2001-06-30"

# The last venue and the last symbol are in no look-up.
VENUES = ["BINANCE", "HYPERLIQUID", "OKX", "BYBIT", "GATE", "KUCOIN", "LIGHTER", "NOVA_dex2x"]
SYMBOLS = ["BTCUSDT", "ETHUSDT", "xyzGOLD", "SP500", "xyzadaUSDT"]
KEYS = len(VENUES) * len(SYMBOLS)
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
RATE_SCALE = 1000 / 1009
FUNDING_SCALE = 5000011


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _choose(names: list[str], index: str) -> str:
    return " ".join([f"CASE {index}", *[f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)], "END"])


def venue(key: str) -> str:
    return _choose(VENUES, f"({key}) % {len(VENUES)}")


def symbol(key: str) -> str:
    return _choose(SYMBOLS, f"({key}) div {len(VENUES)}")


def market_of(key: str, maturity: str) -> str:
    text = f"dayofmonth({maturity}), {_choose(MONTHS, f'month({maturity}) - 1')}, year({maturity})"
    return f"concat_ws('-', {key}, {venue(key)}, {symbol(key)}, concat({text}))"


SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', {})"


def _lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Line items with their market; maturity is the end of the quarter, for every other line of the one after."""
    day = "CAST(l_shipdate AS DATE)"
    maturity = f"last_day(add_months(trunc(add_months({day}, l_linenumber % 2 * 3), 'quarter'), 2))"
    return (
        table(spark, sf, "lineitem")
        .selectExpr("*", f"{day} AS date", f"{maturity} AS mat", f"l_suppkey % {KEYS} AS k")
        .selectExpr(f"{market_of('k', 'mat')} AS market", "date", *columns)
    )


def _rate(name: str) -> str:
    return f"{name} * {RATE_SCALE!r}D"


D, T = _rate("l_discount"), _rate("l_tax")


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(
        spark,
        sf,
        f"{SECONDS.format('l_shipdate')} AS timestamp",
        "l_orderkey AS blockNumber",
        f"IF(l_linenumber <> 7, {D}, NULL) AS midApr",
        f"{D} - 0.001D AS bestBid",
        f"{D} + 0.001D AS bestAsk",
        f"({D} + {T}) / 2 AS ammImpliedApr",
        f"{T} AS markApr",
        "l_extendedprice AS notionalOI",
        f"{D} AS lastTradedApr",
        f"{T} AS latestSettlementApr",
    )


def funding(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .selectExpr("*", f"o_custkey % {KEYS} AS k")
        .selectExpr("*", f"{venue('k')} AS venue", f"{symbol('k')} AS symbol")
        .selectExpr(
            f"{exchange_name('venue')} AS exchange",
            f"{asset_of_symbol('symbol')} AS asset",
            "CAST(o_orderdate AS DATE) AS date",
            f"o_totalprice / {FUNDING_SCALE} AS annualizedFundingRate",
        )
    )


def settlements(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(
        spark,
        sf,
        f"{SECONDS.format('l_shipdate')} AS timestamp",
        "l_orderkey AS blockNumber",
        f"{T} AS settlementApr",
        "concat_ws('-', l_orderkey, l_linenumber) AS txHash",
        "l_returnflag",
    ).where("l_returnflag = 'R'").drop("l_returnflag")


def candles_in(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf, f"{D} AS d", "l_quantity AS q")
    return rows.groupBy("market", "date").agg(
        F.round(F.avg("d"), 6).alias("open"),
        F.round(F.max("d"), 6).alias("high"),
        F.round(F.min("d"), 6).alias("low"),
        F.round(F.sum(F.col("d") * F.col("q")) / F.sum("q"), 6).alias("close"),
        F.sum("q").alias("volume"),
    )
