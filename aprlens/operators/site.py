"""Site data: compact per-market series, statistics over all days, nested payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.markets import with_market_columns
from ..functions.numeric import (
    finite,
    finite_mean,
    number,
    pearson,
    positive_share,
    quantiles,
    smallest_mode,
    spread,
)
from ..functions.timing import days_between
from ..sources.payload import write_nested

SERIES_FIELDS = ["d", "i", "rd", "rf", "db", "fb", "s", "ls", "n", "fd", "ss"]
CANDLE_FIELDS = ["d", "o", "h", "l", "c", "v"]
IDENTITY = ["market", "market_id", "exchange", "asset", "symbol", "maturity"]


def _finite_number(df: DataFrame, name: str, alias: str) -> Column:
    return finite(number(df, name)).alias(alias)


def _count(name: str, alias: str) -> Column:
    return F.coalesce(F.col(name).cast("double").cast("long"), F.lit(0)).alias(alias)


def with_settlement_samples(comparison: DataFrame, settlement_daily: DataFrame) -> DataFrame:
    """Number of settlements of each market day, for a comparison read back from its table."""
    samples = settlement_daily.select("market", "date", F.col("samples").alias("settlementSamples"))
    return comparison.join(samples, ["market", "date"], "left")


def compact_series(comparison: DataFrame) -> DataFrame:
    """Short-named series of every market; values that are not finite count as missing.

    Takes a comparison that carries ``settlementSamples``.
    """
    return comparison.select(
        *IDENTITY,
        F.col("date").cast("date").alias("d"),
        _finite_number(comparison, "impliedApr", "i"),
        _finite_number(comparison, "realizedDailyApr", "rd"),
        _finite_number(comparison, "realizedForwardApr", "rf"),
        _finite_number(comparison, "dailyBasisApr", "db"),
        _finite_number(comparison, "forwardBasisApr", "fb"),
        _finite_number(comparison, "settlementApr", "s"),
        _finite_number(comparison, "latestSettlementApr", "ls"),
        _count("samples", "n"),
        _count("forwardDaysUsed", "fd"),
        F.col("settlementSamples").cast("double").cast("long").alias("ss"),
    )


def candle_series(ohlcv: DataFrame) -> DataFrame:
    """Short-named candles; ``at`` orders a market's candles."""
    at = "periodStartTimestamp" if "periodStartTimestamp" in ohlcv.columns else "date"
    return ohlcv.select(
        "market",
        F.col("date").cast("date").alias("d"),
        *[_finite_number(ohlcv, c, c[0]) for c in ("open", "high", "low", "close", "volume")],
        F.col(at).alias("at"),
    )


def daily_candles(candles: DataFrame) -> DataFrame:
    """One candle per market and day out of :func:`candle_series` of any interval.

    Candles of one market and ``at`` are states of the same one, which only grows: that with the largest volume stays,
    equal ones by close, high, low and open. Those left of a day become one: opening of the first, close of the last,
    highest, lowest, total volume. A missing ``at`` is before all others; missing values add nothing. Tasks reduce both
    steps before they send rows.
    """
    values = ["v", "c", "h", "l", "o"]
    states = candles.groupBy("market", "d", "at").agg(F.max(F.struct(*values)).alias("best"))
    states = states.select("market", "d", "at", "best.*")
    place = F.struct("at")
    return states.groupBy("market", "d").agg(
        F.min_by("o", place).alias("o"),
        F.max("h").alias("h"),
        F.min("l").alias("l"),
        F.max_by("c", place).alias("c"),
        F.sum("v").alias("v"),
        F.min("at").alias("at"),
    )


def underlying_series(underlying_daily: DataFrame) -> DataFrame:
    return underlying_daily.select(
        F.concat_ws("|", F.coalesce("exchange", F.lit("")), F.coalesce("asset", F.lit(""))).alias("pair"),
        F.col("date").cast("date").alias("d"),
        _finite_number(underlying_daily, "realizedApr", "r"),
    )


def volume_stats(candles: DataFrame) -> DataFrame:
    """Volume of a market's last candle, mean and total; candles without volumes total 0."""
    last = F.max_by("v", F.struct("at", "v"))
    return candles.groupBy("market").agg(
        last.alias("latestVolume"),
        F.avg("v").alias("avgVolume"),
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("totalVolume"),
    )


def series_stats(series: DataFrame) -> DataFrame:
    """Statistics of one market's days.

    ``series`` has one row per market and calendar day, so the exact percentiles and the mode of a group
    hold at most a market's life in days, whatever share of the raw rows it had.
    """
    basis = F.col("fb")
    stats = series.groupBy("market").agg(
        F.min("d").alias("firstDate"),
        F.max("d").alias("lastDate"),
        F.count(F.lit(1)).alias("rows"),
        smallest_mode(F.col("ss")).alias("settlementSamplesPerDay"),
        F.max_by("i", "d").alias("latestImplied"),
        F.max_by("rd", "d").alias("latestRealizedDaily"),
        F.max_by("rf", "d").alias("latestRealizedForward"),
        F.max_by("fb", "d").alias("latestForwardBasis"),
        F.avg("i").alias("avgImplied"),
        F.avg("rf").alias("avgRealizedForward"),
        F.avg(basis).alias("avgForwardBasis"),
        quantiles(basis, [0.5, 0.1, 0.9]).alias("points"),
        spread(basis).alias("basisVol"),
        F.avg(F.abs(basis)).alias("meanAbsForwardBasis"),
        positive_share(basis).alias("positiveBasisShare"),
        F.avg("db").alias("avgDailyBasis"),
        pearson(F.col("i"), F.col("rd")).alias("corrImpliedRealizedDaily"),
    )
    return stats.withColumns(
        {
            "medianForwardBasis": F.get("points", F.lit(0)),
            "p10ForwardBasis": F.get("points", F.lit(1)),
            "p90ForwardBasis": F.get("points", F.lit(2)),
        }
    ).drop("points")


def last_date(series: DataFrame) -> DataFrame:
    """One row: the last day any market has."""
    return series.agg(F.max("d").alias("sourceDateMax"))


SUMMARY_FIELDS = [
    "market",
    "marketId",
    "exchange",
    "asset",
    "symbol",
    "maturity",
    "firstDate",
    "lastDate",
    "rows",
    "settlementSamplesPerDay",
    "matured",
    "daysToMaturity",
    "latestImplied",
    "latestRealizedDaily",
    "latestRealizedForward",
    "latestForwardBasis",
    "avgImplied",
    "avgRealizedForward",
    "avgForwardBasis",
    "medianForwardBasis",
    "p10ForwardBasis",
    "p90ForwardBasis",
    "basisVol",
    "meanAbsForwardBasis",
    "positiveBasisShare",
    "avgDailyBasis",
    "corrImpliedRealizedDaily",
    "latestVolume",
    "avgVolume",
    "totalVolume",
]


def site_summary(
    series: DataFrame, candles: DataFrame, latest: DataFrame | None = None, matured_only: bool = False
) -> DataFrame:
    """Statistics of every market over all its days.

    ``latest`` has ``sourceDateMax``; a caller that knows a cheaper way than a pass over the series hands it in.
    """
    # An aggregate has one row whatever the caller handed in, so it is safe to broadcast.
    latest = (last_date(series) if latest is None else latest).agg(F.max("sourceDateMax").alias("sourceDateMax"))
    last, maturity = F.col("sourceDateMax"), F.col("maturity")
    out = (
        with_market_columns(series_stats(series))
        .join(volume_stats(candles), "market", "left")
        .crossJoin(F.broadcast(latest))
        .withColumn("marketId", F.col("market_id"))
        .withColumns({"matured": maturity <= last, "daysToMaturity": days_between(last, maturity)})
        .select(*SUMMARY_FIELDS)
    )
    return out.where("matured") if matured_only else out


def site_bounds(series: DataFrame) -> DataFrame:
    return series.agg(F.min("d").alias("dateMin"), F.max("d").alias("dateMax"))


def market_payload(summary: DataFrame, series: DataFrame, candles: DataFrame) -> DataFrame:
    """One row per market: its summary, its days and its candles, both sorted by day.

    The arrays hold one entry per calendar day of one market; no value spans markets. :func:`write_market_payload`
    writes the same without ever holding an array.
    """
    days = series.groupBy("market").agg(F.sort_array(F.collect_list(F.struct(*SERIES_FIELDS))).alias("series"))
    ohlcv = candles.groupBy("market").agg(F.sort_array(F.collect_list(F.struct(*CANDLE_FIELDS))).alias("ohlcv"))
    none = F.array().cast(ohlcv.schema["ohlcv"].dataType)
    return (
        summary.select("market", F.struct(*SUMMARY_FIELDS).alias("summary"))
        .join(days, "market")
        .join(ohlcv, "market", "left")
        .select("market", "summary", "series", F.coalesce("ohlcv", none).alias("ohlcv"))
    )


def write_market_payload(summary: DataFrame, series: DataFrame, candles: DataFrame, path: str) -> None:
    """JSON lines as :func:`market_payload` has them, for markets of any number of days and candles; a market is in
    them if it has a summary."""
    heads = summary.select("market", F.struct(*SUMMARY_FIELDS).alias("summary"))
    lists = {"series": series.select("market", *SERIES_FIELDS), "ohlcv": candles.select("market", *CANDLE_FIELDS)}
    write_nested(heads, lists, "d", path)


def write_underlying_payload(series: DataFrame, path: str) -> None:
    """A JSON line per pair with its rates by day."""
    write_nested(series.select("pair").distinct(), {"rates": series.select("pair", "d", "r")}, "d", path)
