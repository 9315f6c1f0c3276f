"""One implied series per exchange for an asset, stitched from its markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.markets import with_market_columns


def cross_exchange(series: DataFrame) -> DataFrame:
    """Per asset, exchange and day the implied rate of the nearest maturity, equal maturities averaged.

    Two aggregates instead of a window: both reduce before their shuffle, so no group is sorted whole.
    """
    present = series.where(F.col("i").isNotNull() & F.col("maturity").isNotNull())
    return (
        present.groupBy("asset", "exchange", "d", "maturity")
        .agg(F.avg("i").alias("i"))
        .groupBy("asset", "exchange", "d")
        .agg(F.min("maturity").alias("maturity"), F.min_by("i", "maturity").alias("implied"))
    )


def exchanges_of(markets: DataFrame, asset: str) -> list[str]:
    """The exchanges that have a market of the asset, alphabetical; reads the column ``market`` only. The list is
    as long as there are venues."""
    named = with_market_columns(markets.select("market").distinct()).where(F.col("asset") == asset)
    return sorted(r["exchange"] for r in named.where(F.col("exchange").isNotNull()).select("exchange").distinct().collect())


def cross_exchange_wide(stitched: DataFrame, asset: str, exchanges: list[str]) -> DataFrame:
    """One row per day, one column per exchange in alphabetical order, NULL where it has no rate.

    ``exchanges`` are the asset's (:func:`exchanges_of`). The job fails on an exchange that is not among them;
    :func:`cross_exchange_map` needs no list.
    """
    rates = stitched.where(F.col("asset") == asset)
    unknown = F.raise_error(F.concat(F.lit("exchange is not in the list: "), F.coalesce("exchange", F.lit("NULL"))))
    rates = rates.where(F.when(F.col("exchange").isin(exchanges), True).otherwise(unknown))
    columns = [F.max(F.when(F.col("exchange") == name, F.col("implied"))).alias(name) for name in sorted(exchanges)]
    return rates.groupBy("d").agg(*columns)


def cross_exchange_map(stitched: DataFrame) -> DataFrame:
    """Per asset and day the rate of each exchange, as a map: as many entries as there are venues."""
    entry = F.struct("exchange", "implied")
    rates = F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("implied")
    return stitched.where(F.col("exchange").isNotNull()).groupBy("asset", "d").agg(rates)
