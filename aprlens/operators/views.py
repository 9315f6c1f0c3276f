"""Market board and what is shown of it: filters, lens, ranking, key figures, drill-down."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.markets import with_market_columns
from ..functions.numeric import finite
from ..functions.rates import above_diagonal, gap_class, gap_label

ALL = "all"


def gap_size() -> Column:
    return F.abs(F.coalesce("gapSum", F.lit(0.0)))


def market_board(series: DataFrame) -> DataFrame:
    """Per market the summed forward gap (NULL without any) and its averages."""
    board = series.groupBy("market").agg(
        F.sum(finite(F.col("fb"))).alias("gapSum"),
        F.avg("i").alias("avgImplied"),
        F.avg("rf").alias("avgRealizedForward"),
        F.avg("fb").alias("avgForwardBasis"),
    )
    return with_market_columns(board).select(
        "market", "exchange", "asset", "maturity", *[c for c in board.columns if c != "market"]
    )


# What the board is made of, by column of the comparison.
_MEANS = {"avgImplied": "impliedApr", "avgRealizedForward": "realizedForwardApr", "avgForwardBasis": "forwardBasisApr"}


def gap_partials(comparison: DataFrame) -> DataFrame:
    """Per market and month the sums and counts the board is made of: kept, they spare it the comparison."""
    sums = [F.sum(finite(F.col("forwardBasisApr"))).alias("gapSum")]
    for name, column in _MEANS.items():
        value = finite(F.col(column))
        sums += [F.sum(value).alias(f"{name}Sum"), F.count(value).alias(f"{name}Count")]
    return comparison.groupBy("market", F.trunc("date", "month").alias("month")).agg(*sums)


def board_of(partials: DataFrame) -> DataFrame:
    """:func:`market_board` of all days behind ``partials``."""
    means = [(F.sum(f"{n}Sum") / F.nullif(F.sum(f"{n}Count"), F.lit(0))).alias(n) for n in _MEANS]
    board = partials.groupBy("market").agg(F.sum("gapSum").alias("gapSum"), *means)
    return with_market_columns(board).select("market", "exchange", "asset", "maturity", "gapSum", *_MEANS)


def with_gap_label(board: DataFrame) -> DataFrame:
    gap = F.col("avgForwardBasis")
    return board.withColumns({"gapLabel": gap_label(gap), "gapClass": gap_class(gap)})


def shown(
    exchange: str = ALL, asset: str = ALL, maturity: dt.date | str = ALL, lens: str = ALL
) -> Column:
    """Condition for markets of an exchange, asset and maturity; a lens keeps gaps of one sign, never a missing one."""
    keep = F.lit(True)
    for name, value in (("exchange", exchange), ("asset", asset)):
        if value != ALL:
            keep = keep & (F.col(name) == value)
    if maturity != ALL:
        keep = keep & (F.col("maturity") == F.lit(maturity).cast("date"))
    if lens == "paid":
        keep = keep & (F.col("gapSum") > 0)
    if lens == "received":
        keep = keep & (F.col("gapSum") < 0)
    return keep


def filter_markets(board: DataFrame, **filters) -> DataFrame:
    """Markets of the board that ``shown(**filters)`` keeps."""
    return board.where(shown(**filters))


def kept_markets(names: DataFrame, exchange: str = ALL, asset: str = ALL, maturity: dt.date | str = ALL) -> DataFrame:
    """The markets among ``names`` that the filters keep, from their names alone: what a lens asks for needs the
    gaps, the rest can be restricted before anything is compared."""
    named = with_market_columns(names.select("market").distinct())
    return named.where(shown(exchange, asset, maturity)).select("market")


def by_gap() -> list[Column]:
    return [gap_size().desc(), F.col("market").asc()]


def rank_by_gap(board: DataFrame) -> DataFrame:
    return board.orderBy(*by_gap())


def largest_gap(board: DataFrame) -> DataFrame:
    return rank_by_gap(board).limit(1)


def board_kpis(board: DataFrame) -> DataFrame:
    """Number of markets, mean size of the gap with a missing one as 0, markets on either side."""
    gap = F.col("gapSum")
    return board.agg(
        F.count(F.lit(1)).alias("markets"),
        F.avg(gap_size()).alias("avgAbsGapSum"),
        F.count_if(gap > 0).alias("paidMore"),
        F.count_if(gap < 0).alias("receivedMore"),
    )


def select_market(board: DataFrame, wanted: str | None = None, **filters) -> DataFrame:
    """One row: the wanted market if it is shown, else the first one shown, else the first of the board."""
    is_shown = shown(**filters)
    choice = F.when(is_shown & (F.col("market") == F.lit(wanted)), 0).when(is_shown, 1).otherwise(2)
    ranked = board.select("market", choice.alias("choice"), F.when(is_shown, gap_size()).alias("size"))
    return ranked.orderBy("choice", F.col("size").desc(), "market").limit(1).select("market")


def drilldown(series: DataFrame, selected: DataFrame) -> DataFrame:
    """The days of the selected market; ``selected`` is a single row, so it is broadcast."""
    return series.join(F.broadcast(selected.select("market").limit(1)), "market", "left_semi")


def market_map(board: DataFrame) -> DataFrame:
    """Markets with both averages, and whether implied lies above realized."""
    implied, realized = F.col("avgImplied"), F.col("avgRealizedForward")
    return board.where(implied.isNotNull() & realized.isNotNull()).select(
        "market",
        "exchange",
        "asset",
        "maturity",
        "avgImplied",
        "avgRealizedForward",
        "avgForwardBasis",
        above_diagonal(implied, realized).alias("aboveDiagonal"),
    )


def option_lists(markets: DataFrame) -> DataFrame:
    """Distinct exchanges, assets and maturities, from one pass over the markets."""
    options = [
        F.struct(F.lit(name).alias("kind"), F.col(name).cast("string").alias("value"))
        for name in ("exchange", "asset", "maturity")
    ]
    return markets.select(F.explode(F.array(*options)).alias("option")).select("option.*").distinct()


def default_asset(markets: DataFrame, preferred: str = "BTC") -> DataFrame:
    """The asset first shown across exchanges: the preferred one where it exists, else the first by name."""
    asset = F.col("asset")
    return markets.agg(F.coalesce(F.max(F.when(asset == preferred, asset)), F.min(asset)).alias("asset"))
