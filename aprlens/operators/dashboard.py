"""Market summaries over the days that have a forward average, and what the dashboard shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.markets import with_market_columns
from ..functions.numeric import finite, finite_mean, pearson
from ..functions.rates import basis_points, percent

# Markets shown in the basis table, strongest shade of the heat table.
TOP_MARKETS = 24
MAX_INTENSITY = 0.82


def forward_rows(comparison: DataFrame) -> DataFrame:
    return comparison.where(F.col("realizedForwardApr").isNotNull())


def market_summary(comparison: DataFrame) -> DataFrame:
    """Averages, last values and daily correlation per market.

    A market contributes one row per calendar day and every statistic is algebraic.
    """
    implied, ahead, basis = F.col("impliedApr"), F.col("realizedForwardApr"), F.col("forwardBasisApr")
    stats = (
        forward_rows(comparison)
        .groupBy("market")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("date").alias("firstDate"),
            F.max("date").alias("lastDate"),
            percent(finite_mean(implied)).alias("avgImpliedPct"),
            percent(finite_mean(ahead)).alias("avgRealizedForwardPct"),
            basis_points(finite_mean(basis)).alias("avgBasisBps"),
            basis_points(finite_mean(F.abs(basis))).alias("meanAbsBasisBps"),
            percent(F.max_by(implied, "date")).alias("lastImpliedPct"),
            percent(F.max_by(ahead, "date")).alias("lastRealizedForwardPct"),
            pearson(implied, F.col("realizedDailyApr")).alias("corrDaily"),
        )
    )
    return with_market_columns(stats).select(
        "market", "exchange", "asset", "symbol", "maturity", *[c for c in stats.columns if c != "market"]
    )


def by_basis() -> list[Column]:
    return [F.abs(F.coalesce("avgBasisBps", F.lit(0.0))).desc(), F.col("market").asc()]


def ranked_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(*by_basis())


def top_markets(summary: DataFrame, limit: int = TOP_MARKETS) -> DataFrame:
    return ranked_summary(summary).limit(limit)


def market_list(summary: DataFrame) -> DataFrame:
    """Markets by length of history, then by size of basis."""
    return summary.select("market", "rows", "firstDate", "lastDate", "avgBasisBps").orderBy(
        F.col("rows").desc(), *by_basis()
    )


def heatmap(summary: DataFrame) -> DataFrame:
    """Per exchange and asset the mean of the markets' means, each market counting once."""
    return summary.groupBy("exchange", "asset").agg(
        finite_mean(F.col("avgBasisBps")).alias("avgBasisBps"), F.count(F.lit(1)).alias("markets")
    )


def heat_intensity(heat: DataFrame) -> DataFrame:
    """Shade of each heat cell: its basis relative to the largest one (at least 1 bp), and the sign."""
    size = F.abs(F.coalesce("avgBasisBps", F.lit(0.0)))
    largest = heat.agg(F.greatest(F.max(F.abs(finite(F.col("avgBasisBps")))), F.lit(1.0)).alias("largest"))
    return heat.crossJoin(F.broadcast(largest)).select(
        "exchange",
        "asset",
        "markets",
        "avgBasisBps",
        F.least(F.lit(MAX_INTENSITY), size / F.col("largest")).alias("intensity"),
        (F.coalesce("avgBasisBps", F.lit(0.0)) >= 0).alias("positive"),
    )


def dashboard_bounds(summary: DataFrame) -> DataFrame:
    """Date range, row and market counts and mean absolute basis, all from the market summaries."""
    return summary.agg(
        F.min("firstDate").alias("dateMin"),
        F.max("lastDate").alias("dateMax"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rowCount"),
        F.count(F.lit(1)).alias("marketCount"),
        finite_mean(F.col("meanAbsBasisBps")).alias("avgAbsBasisBps"),
    )


def market_series(comparison: DataFrame) -> DataFrame:
    """Daily values in percent and basis points."""
    return forward_rows(comparison).select(
        "market",
        "date",
        percent(F.col("impliedApr")).alias("implied"),
        percent(F.col("realizedDailyApr")).alias("realizedDaily"),
        percent(F.col("realizedForwardApr")).alias("realizedForward"),
        basis_points(F.col("forwardBasisApr")).alias("basisBps"),
    )
