"""Daily roll-ups of raw observations.

All three are algebraic aggregates, so each task reduces its own rows before the shuffle and one market or
pair holding most of the rows still arrives as one small partial row per task and day. Groups are keyed by
the shortest unique key; what a market name implies is derived again from the name afterwards.

The same aggregates come in two halves where archives arrive bit by bit: ``partials`` reduces a batch to sums and counts
per key and day, which are kept, and ``merged`` adds up the partials of any number of batches and divides. Only days that a
batch has rows of are merged anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.markets import with_market_columns
from ..functions.numeric import finite, finite_mean, number

SNAPSHOT_METRICS = ["midApr", "markApr", "ammImpliedApr", "latestSettlementApr", "notionalOI"]
MARKET_KEYS = ["market", "market_id", "exchange", "asset", "symbol", "maturity"]


def market_daily(snapshots: DataFrame) -> DataFrame:
    """Per market and day: all snapshots counted, finite values averaged."""
    means = [finite_mean(number(snapshots, c)).alias(c) for c in SNAPSHOT_METRICS]
    daily = snapshots.groupBy("market", "date").agg(F.count(F.lit(1)).alias("samples"), *means)
    return with_market_columns(daily).select(*MARKET_KEYS, "date", "samples", *SNAPSHOT_METRICS)


def underlying_daily(funding: DataFrame) -> DataFrame:
    """Per exchange, asset and day: rates that are numbers counted (NaN is one), finite ones averaged."""
    rate = number(funding, "annualizedFundingRate")
    return (
        funding.select("exchange", "asset", "date", rate.alias("rate"))
        .where(F.col("rate").isNotNull())
        .groupBy("exchange", "asset", "date")
        .agg(F.count(F.lit(1)).alias("samples"), finite_mean(F.col("rate")).alias("realizedApr"))
    )


def settlement_rates(settlements: DataFrame) -> DataFrame:
    """Per market and day: all settlements counted, finite rates averaged. All that a join with it needs."""
    rate = finite_mean(number(settlements, "settlementApr")).alias("settlementApr")
    return settlements.groupBy("market", "date").agg(F.count(F.lit(1)).alias("samples"), rate)


def settlement_daily(settlements: DataFrame) -> DataFrame:
    """The same with what the market names imply."""
    daily = with_market_columns(settlement_rates(settlements))
    return daily.select(*MARKET_KEYS, "date", "samples", "settlementApr")


@dataclass(frozen=True)
class DailyTable:
    """A daily table as sums: its keys beside the day, the means it holds by source column, and whether a row counts only
    where its (single) value is a number."""

    keys: tuple[str, ...]
    means: dict[str, str]
    only_numbers: bool = False

    @property
    def days(self) -> list[str]:
        return [*self.keys, "date"]

    @property
    def sums(self) -> list[str]:
        return ["samples", *[f"{name}{part}" for name in self.means.values() for part in ("Sum", "Count")]]

    @property
    def partial_schema(self) -> str:
        kinds = {c: "double" if c.endswith("Sum") else "long" for c in self.sums}
        return ", ".join([*[f"{k} string" for k in self.keys], "date date", *[f"{c} {kind}" for c, kind in kinds.items()]])


MARKET_DAYS = DailyTable(("market",), {c: c for c in SNAPSHOT_METRICS})
UNDERLYING_DAYS = DailyTable(("exchange", "asset"), {"annualizedFundingRate": "realizedApr"}, only_numbers=True)
SETTLEMENT_DAYS = DailyTable(("market",), {"settlementApr": "settlementApr"})


def partials(rows: DataFrame, kind: DailyTable) -> DataFrame:
    """Per key and day: rows, and sum and count of the finite values of each mean."""
    values = {name: number(rows, column) for column, name in kind.means.items()}
    rows = rows.select(*kind.days, *[v.alias(n) for n, v in values.items()])
    if kind.only_numbers:
        rows = rows.where(F.col(next(iter(values))).isNotNull())
    sums = [agg(finite(F.col(n))).alias(f"{n}{part}") for n in values for part, agg in (("Sum", F.sum), ("Count", F.count))]
    return rows.groupBy(*kind.days).agg(F.count(F.lit(1)).alias("samples"), *sums)


def added(parts: DataFrame, kind: DailyTable) -> DataFrame:
    """Partials of several batches as those of all their rows."""
    return parts.groupBy(*kind.days).agg(*[F.sum(c).alias(c) for c in kind.sums])


def merged(parts: DataFrame, kind: DailyTable) -> DataFrame:
    """The daily table of all rows behind ``parts``: what one pass over these rows would give."""
    means = [(F.col(f"{n}Sum") / F.nullif(F.col(f"{n}Count"), F.lit(0))).alias(n) for n in kind.means.values()]
    daily = added(parts, kind).select(*kind.days, "samples", *means)
    if kind.keys != ("market",):
        return daily
    return with_market_columns(daily).select(*MARKET_KEYS, "date", "samples", *kind.means.values())
