"""Daily comparison of what a market implied with what funding then delivered."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.markets import with_market_columns
from ..functions.timing import as_date
from .daily import MARKET_KEYS
from .forward import PAIR, rate_pages, touched_by, with_paged_average

COMPARISON_COLUMNS = [
    *MARKET_KEYS,
    "date",
    "samples",
    "impliedApr",
    "markApr",
    "ammImpliedApr",
    "latestSettlementApr",
    "settlementApr",
    "realizedDailyApr",
    "realizedForwardApr",
    "forwardDaysUsed",
    "dailyBasisApr",
    "forwardBasisApr",
]


def with_daily_realized(market_daily: DataFrame, underlying_daily: DataFrame) -> DataFrame:
    """Each market day with its pair's rate of that day."""
    rates = underlying_daily.select(*PAIR, "date", F.col("realizedApr").alias("realizedDailyApr"))
    return market_daily.join(rates, [*PAIR, "date"], "left")


def with_settlement(market_daily: DataFrame, settlement_daily: DataFrame) -> DataFrame:
    """Each market day with its settlement rate and how many settlements that day had.

    Both sides come out of an aggregate on (market, date), so the join adds no shuffle.
    """
    settled = settlement_daily.select("market", "date", "settlementApr", F.col("samples").alias("settlementSamples"))
    return market_daily.join(settled, ["market", "date"], "left")


def comparison_with_samples(
    market_daily: DataFrame,
    underlying_daily: DataFrame,
    settlement_daily: DataFrame,
    as_of: Column | dt.date | str | None = None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """The comparison plus ``settlementSamples``, for jobs that go on to the per-market series. ``pages``: rate pages that
    are kept, else they are built from ``underlying_daily``."""
    as_of = as_date(as_of)
    rows = with_daily_realized(with_settlement(market_daily, settlement_daily), underlying_daily)
    rows = with_paged_average(rows, rate_pages(underlying_daily, as_of) if pages is None else pages, as_of)
    derived = {
        "impliedApr": "coalesce(midApr, markApr)",
        "dailyBasisApr": "coalesce(midApr, markApr) - realizedDailyApr",
        "forwardBasisApr": "coalesce(midApr, markApr) - realizedForwardApr",
    }
    columns = [f"{derived[c]} AS {c}" if c in derived else c for c in COMPARISON_COLUMNS]
    return rows.selectExpr(*columns, "settlementSamples")


def apr_comparison(
    market_daily: DataFrame,
    underlying_daily: DataFrame,
    settlement_daily: DataFrame,
    as_of: Column | dt.date | str | None = None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """One row per market and day; no market day is lost for want of a rate or a settlement."""
    rows = comparison_with_samples(market_daily, underlying_daily, settlement_daily, as_of, pages)
    return rows.select(*COMPARISON_COLUMNS)


def restricted(
    market_daily: DataFrame, underlying_daily: DataFrame, settlement_daily: DataFrame, kept: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three daily tables for the markets in ``kept`` (column ``market``) and the pairs these refer to, to
    compare just them. Spark broadcasts the names where they are few."""
    names = kept.select("market").distinct()
    pairs = with_market_columns(names).select(*PAIR).distinct()
    return (
        market_daily.join(names, "market", "left_semi"),
        underlying_daily.join(pairs, PAIR, "left_semi"),
        settlement_daily.join(names, "market", "left_semi"),
    )


def stale_rows(
    market_daily: DataFrame,
    changed_markets: DataFrame,
    changed_pairs: DataFrame,
    as_of: Column | dt.date | str | None = None,
) -> DataFrame:
    """``market, date`` of the comparison's rows that late days make stale.

    ``changed_markets`` (market, date): days with new snapshots or settlements; ``changed_pairs`` (exchange, asset, date):
    days with new rates, which also concern the rows whose forward window holds them.
    """
    rows = market_daily.select("market", *PAIR, "maturity", "date")
    own = rows.select("market", "date").join(changed_markets.select("market", "date").distinct(), ["market", "date"], "left_semi")
    return own.unionByName(touched_by(rows, changed_pairs, as_of).select("market", "date")).distinct()


def refreshed(
    comparison: DataFrame,
    stale: DataFrame,
    market_daily: DataFrame,
    underlying_daily: DataFrame,
    settlement_daily: DataFrame,
    as_of: Column | dt.date | str | None = None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """``comparison`` with its ``stale`` rows (market, date) compared again and all others as they are."""
    days = market_daily.join(stale, ["market", "date"], "left_semi")
    again = comparison_with_samples(days, underlying_daily, settlement_daily, as_of, pages)
    old = comparison.join(stale, ["market", "date"], "left_anti")
    return old.unionByName(again.select(*comparison.columns))
