"""Derived chart data: settlement difference, value domains, histogram, candles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import finite, smallest_mode
from ..functions.rates import candle_up, funding_bps
from .scan import running_sums

# Padding of a value axis, histogram resolution.
PAD = 0.08
BUCKETS = 18


def settlement_diff(series: DataFrame) -> DataFrame:
    """Implied against settled funding of each day, and the running difference of each market.

    A market's usual number of settlements per day gives the length of a period; 0 counts as missing. A day
    without a difference shows none and leaves the running sum as it was. The windows hold one market's
    days, one row each.
    """
    market = Window.partitionBy("market")
    to_date = market.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    own = F.nullif(F.col("ss"), F.lit(0))
    per_day, periods = F.col("settlementsPerDay"), F.col("settlementPeriods")
    diff = finite((F.col("impliedFundingBps") - F.col("settlementFundingBps")) * periods)
    return (
        series.select("market", "d", "i", "s", "ss")
        .withColumn("usual", smallest_mode(F.col("ss")).over(market))
        .withColumn("settlementsPerDay", F.coalesce(F.nullif(F.col("usual"), F.lit(0)), own))
        .withColumn("settlementPeriods", F.coalesce(own, per_day))
        .withColumns(
            {"impliedFundingBps": funding_bps(F.col("i"), per_day), "settlementFundingBps": funding_bps(F.col("s"), per_day)}
        )
        .withColumn("diffBps", diff)
        .withColumn("cumulativeSettlementDiffBps", F.when(F.col("diffBps").isNotNull(), F.sum("diffBps").over(to_date)))
        .drop("usual", "diffBps")
    )


def running_diff_by_month(diffs: DataFrame, day: str = "d") -> DataFrame:
    """``market, day, diff`` with the running ``sum`` of each market: NULL where there is no difference. Months are summed
    apart and carried on, so differences may come at any frequency."""
    summed = running_sums(diffs, ["market"], [day], F.trunc(day, "month"), {"sum": finite(F.col("diff"))})
    return summed.withColumn("sum", F.when(finite(F.col("diff")).isNotNull(), F.col("sum")))


def padded_domain(df: DataFrame, values: list[Column], by: list[str] | None = None) -> DataFrame:
    """``lo, hi`` around the finite values: padded, widened by 1 when all are equal, [0, 1] when there are none."""
    values = [finite(v) for v in values]
    low = reduce(F.least, [F.min(v) for v in values]) if len(values) > 1 else F.min(values[0])
    high = reduce(F.greatest, [F.max(v) for v in values]) if len(values) > 1 else F.max(values[0])
    grouped = df.groupBy(*by) if by else df.groupBy()
    flat = F.when(F.col("low") == F.col("high"), 1.0).otherwise(0.0)
    pad = (F.col("high") - F.col("low") + 2 * flat) * PAD + flat
    return grouped.agg(low.alias("low"), high.alias("high")).select(
        *(by or []),
        F.coalesce(F.col("low") - pad, F.lit(0.0)).alias("lo"),
        F.coalesce(F.col("high") + pad, F.lit(1.0)).alias("hi"),
    )


def null_safe_join(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on equal columns that takes NULL for equal to NULL; keeps the left ones."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return left.join(right, same, how).drop(*[f"_{c}" for c in by])


def histogram(df: DataFrame, value: Column, by: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Counts of the finite values in equal buckets over their padded domain; empty buckets are kept.

    Without ``by`` the domain is one row and broadcast; with it, it is joined on ``by``, where NULL is a group too.
    """
    by = by or []
    domain = padded_domain(df, [value], by)
    points = df.select(*by, finite(value).alias("value")).where(F.col("value").isNotNull())
    ranged = null_safe_join(points, domain, by) if by else points.crossJoin(F.broadcast(domain))
    place = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)
    counts = (
        ranged.select(*by, F.greatest(F.lit(0), F.least(F.lit(buckets - 1), place)).cast("long").alias("bucket"))
        .groupBy(*by, "bucket")
        .agg(F.count(F.lit(1)).alias("days"))
    )
    step = (F.col("hi") - F.col("lo")) / buckets
    grid = domain.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return null_safe_join(grid, counts, [*by, "bucket"], "left").select(
        *by,
        "bucket",
        (F.col("lo") + F.col("bucket") * step).alias("lo"),
        (F.col("lo") + (F.col("bucket") + 1) * step).alias("hi"),
        F.coalesce("days", F.lit(0)).alias("days"),
        (F.col("lo") + (F.col("bucket") + 0.5) * step >= 0).alias("positive"),
    )


def candles(candle_series: DataFrame) -> DataFrame:
    """Direction of each complete candle and each volume relative to its market's largest (at least 1).

    The largest volume is an aggregate joined back, so a market with very many candles is not sorted whole.
    """
    largest = candle_series.groupBy("market").agg(F.greatest(F.max("v"), F.lit(1.0)).alias("largest"))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in "ohlc"])
    return candle_series.join(largest, "market").select(
        "market",
        *["d", "o", "h", "l", "c", "v"],
        F.when(whole, candle_up(F.col("o"), F.col("c"))).alias("up"),
        (F.col("v") / F.col("largest")).alias("volumeShare"),
    )
