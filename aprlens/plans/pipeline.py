"""Archives to clean tables, daily tables, comparison, dashboard and site data.

Each step reads tables and writes tables, so a later step never repeats an earlier one's scan and a lost
executor costs at most the step it was in. Everything lies below one output folder, which executors and
driver must share.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators import charts, clean, compare, cross, daily, dashboard, site, views
from ..sources.manifest import landed_files, pending_files, read_manifest, select_files, transfer_summary
from ..sources.payload import require_finite
from ..sources.tables import read_table, write_sorted, write_table

# Names of the clean tables.
CLEAN_TABLES = {
    "market_data": clean.MARKET_DATA,
    "underlying_apr": clean.UNDERLYING,
    "settlement": clean.SETTLEMENT,
    "ohlcv_1d": clean.OHLCV_1D,
}


def transfer_plan(
    spark: SparkSession,
    manifest: str,
    raw_root: str,
    include: list[str] | None = None,
    trades: bool = False,
    order_book: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Files a run still has to fetch, and the summary by status."""
    wanted = select_files(read_manifest(spark, manifest), include, trades, order_book)
    landed = landed_files(spark, raw_root)
    return pending_files(wanted, landed), transfer_summary(wanted, landed)


class Counts(NamedTuple):
    accepted: int
    rejected: int


def clean_tables(
    spark: SparkSession, raw_root: str, out: str, strict: bool = False, fmt: str = "parquet"
) -> dict[str, Counts]:
    """Write the four clean tables and, with their reason, the rejected lines of each to ``<table>_rejected``: one pass
    over the archives writes and counts both. Returns the counts."""
    counts = {}
    for name, dataset in CLEAN_TABLES.items():
        seen = Observation(name)
        lines = clean.read_lines(spark, raw_root, dataset)
        clean.write_checked(lines, dataset, f"{out}/{name}", f"{out}/{name}_rejected", seen, strict, fmt)
        counts[name] = Counts(seen.get["accepted"], seen.get["rejected"])
    return counts


def rejected_lines(spark: SparkSession, raw_root: str) -> DataFrame:
    """Lines no clean table has, with the reason."""
    parts = [clean.rejected(clean.read_lines(spark, raw_root, d), d) for d in CLEAN_TABLES.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def daily_tables(
    spark: SparkSession, out: str, as_of: Column | dt.date | str | None = None, fmt: str = "parquet"
) -> None:
    """Write the three daily tables and the comparison."""

    def stored(name: str) -> DataFrame:
        return read_table(spark, f"{out}/{name}", fmt, CLEAN_TABLES[name].types)

    by_market, by_pair = ["market", "date"], ["exchange", "asset", "date"]
    write_sorted(daily.market_daily(stored("market_data")), f"{out}/market_daily_apr", by_market)
    write_sorted(daily.underlying_daily(stored("underlying_apr")), f"{out}/underlying_daily_apr", by_pair)
    write_sorted(daily.settlement_daily(stored("settlement")), f"{out}/settlement_daily_apr", by_market)
    days = [read_table(spark, f"{out}/{n}_daily_apr") for n in ("market", "underlying", "settlement")]
    write_sorted(compare.apr_comparison(*days, as_of=as_of), f"{out}/apr_comparison_daily", by_market)


def dashboard_tables(spark: SparkSession, out: str) -> None:
    """Write market summaries, heat map with shades, bounds and series of the dashboard."""
    comparison = read_table(spark, f"{out}/apr_comparison_daily")
    write_table(dashboard.ranked_summary(dashboard.market_summary(comparison)), f"{out}/market_summary")
    summary = read_table(spark, f"{out}/market_summary")
    write_sorted(dashboard.heatmap(summary), f"{out}/heatmap", ["exchange", "asset"])
    write_table(dashboard.heat_intensity(read_table(spark, f"{out}/heatmap")), f"{out}/heat_intensity")
    write_table(dashboard.dashboard_bounds(summary), f"{out}/dashboard_bounds")
    write_sorted(require_finite(dashboard.market_series(comparison)), f"{out}/market_series", ["market", "date"])


def site_tables(spark: SparkSession, out: str, fmt: str = "parquet", matured_only: bool = False) -> None:
    """Write series, candles, summaries, nested payloads and the derived views of the site."""
    comparison = read_table(spark, f"{out}/apr_comparison_daily")
    settled = read_table(spark, f"{out}/settlement_daily_apr")
    funding = read_table(spark, f"{out}/underlying_daily_apr")
    ohlcv = read_table(spark, f"{out}/ohlcv_1d", fmt, clean.OHLCV_1D.types)

    series = site.compact_series(site.with_settlement_samples(comparison, settled))
    write_sorted(series, f"{out}/site_series", ["market", "d"])
    write_sorted(site.daily_candles(site.candle_series(ohlcv)), f"{out}/site_candles", ["market", "d"])
    series, candles = read_table(spark, f"{out}/site_series"), read_table(spark, f"{out}/site_candles")
    write_sorted(site.site_summary(series, candles, matured_only=matured_only), f"{out}/site_summary", ["market"])
    write_table(site.site_bounds(series), f"{out}/site_bounds")
    summary = read_table(spark, f"{out}/site_summary")
    site.write_market_payload(summary, series, candles, f"{out}/site_markets_json")
    site.write_underlying_payload(site.underlying_series(funding), f"{out}/site_underlying_json")

    write_table(views.market_board(series), f"{out}/market_board")
    write_table(charts.settlement_diff(series), f"{out}/settlement_diff")
    write_table(cross.cross_exchange(series), f"{out}/cross_exchange")
    write_table(charts.candles(candles), f"{out}/candles")


def run(
    spark: SparkSession, raw_root: str, out: str, as_of: Column | dt.date | str | None = None, strict: bool = False
) -> dict[str, Counts]:
    """All steps; returns the counts of accepted and rejected lines."""
    rows = clean_tables(spark, raw_root, out, strict)
    daily_tables(spark, out, as_of)
    dashboard_tables(spark, out)
    site_tables(spark, out)
    return rows
