"""Cleaning: parsed archive lines to typed tables.

Every table has one row per accepted line. A line that cannot be dated or placed is rejected with a reason:
``strict`` makes a job fail on the first one, otherwise ``rejected`` lists them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.markets import (
    MARKET_COLUMNS,
    funding_asset,
    funding_exchange,
    is_market_name,
    with_market_columns,
)
from ..functions.timing import FIRST_SECOND, LAST_SECOND, datetime_or_iso, utc_date
from ..sources.archives import ARCHIVE_SUFFIX, BAD_LINE, parse_lines, scan_archives
from ..sources.tables import drop_folder, staged_split, write_sorted, write_table


@dataclass(frozen=True)
class Dataset:
    prefix: str
    timestamp: str
    texts: tuple[str, ...]
    longs: tuple[str, ...]
    numbers: tuple[str, ...]
    columns: tuple[str, ...]
    per_market: bool = True

    @property
    def number_fields(self) -> list[str]:
        return [self.timestamp, *self.longs, *self.numbers]

    @property
    def types(self) -> dict[str, str]:
        """Spark types of the table's columns, for files that hold none."""
        known = dict.fromkeys(("date", "maturity"), "date") | dict.fromkeys((self.timestamp, *self.longs), "bigint")
        known |= dict.fromkeys(self.numbers, "double")
        return {c: known.get(c, "string") for c in self.columns}

    @property
    def order(self) -> list[str]:
        return [*(["market"] if self.per_market else ["exchange", "asset"]), self.timestamp]

    @property
    def text_fields(self) -> list[str]:
        return ["datetime", *self.texts]


_MARKET = ("market", *MARKET_COLUMNS)
_APR_FIELDS = (
    "midApr", "bestBid", "bestAsk", "ammImpliedApr", "markApr", "notionalOI", "lastTradedApr", "latestSettlementApr",
)
_CANDLE_FIELDS = ("open", "high", "low", "close", "volume")

MARKET_DATA = Dataset(
    "market-data", "timestamp", (), ("blockNumber",), _APR_FIELDS,
    (*_MARKET, "timestamp", "datetime", "date", "blockNumber", *_APR_FIELDS, "source_path"),
)
UNDERLYING = Dataset(
    "underlying-apr", "timestamp", (), (), ("annualizedFundingRate",),
    ("exchange", "asset", "timestamp", "datetime", "date", "annualizedFundingRate", "source_path"), per_market=False,
)
SETTLEMENT = Dataset(
    "settlement", "timestamp", ("txHash",), ("blockNumber",), ("settlementApr",),
    (*_MARKET, "timestamp", "datetime", "date", "blockNumber", "settlementApr", "txHash", "source_path"),
)
OHLCV_1D = Dataset(
    "ohlcv/1d", "periodStartTimestamp", (), (), _CANDLE_FIELDS,
    (*_MARKET, "periodStartTimestamp", "datetime", "date", *_CANDLE_FIELDS, "source_path"),
)


def place_by_path(df: DataFrame, dataset: Dataset) -> DataFrame:
    """Add what the archive's path says: its market's columns, or exchange and asset of a funding file."""
    steps = "split(source_path, '/')"
    if dataset.per_market:
        return with_market_columns(df.selectExpr("*", f"element_at({steps}, -2) AS market"))
    stem = f"replace(element_at({steps}, -1), '{ARCHIVE_SUFFIX}', '')"
    return df.selectExpr("*", f"{funding_exchange(stem)} AS exchange", f"{funding_asset(stem)} AS asset")


def read_lines(spark: SparkSession, root: str, dataset: Dataset) -> DataFrame:
    """Lines of a dataset's archives, placed by path before they are split into rows."""
    return lines_of(scan_archives(spark, root, dataset.prefix), dataset)


def lines_of(blocks: DataFrame, dataset: Dataset) -> DataFrame:
    return parse_lines(place_by_path(blocks, dataset), dataset.number_fields, dataset.text_fields)


def epoch_seconds(value: Column) -> Column:
    """Whole seconds, NULL outside the years a date can have."""
    return F.when(value.between(FIRST_SECOND, LAST_SECOND), value.cast("long"))


def _typed(lines: DataFrame, dataset: Dataset) -> DataFrame:
    """All lines with typed values and ``reject_reason``, NULL for a good line."""
    if dataset.per_market:
        misplaced = F.col("maturity").isNull() & F.expr(is_market_name("market"))  # the cheap test first, for every line
        reason = F.when(misplaced, "market name holds no valid maturity")
    else:
        reason = F.when(F.col("exchange").isNull(), "funding file name holds no asset")
    seconds = F.col(dataset.timestamp)
    problem = F.col("problem") if "problem" in lines.columns else F.lit(None).cast("string")
    return (
        lines.withColumn(dataset.timestamp, epoch_seconds(seconds))
        .withColumns({c: F.col(c).try_cast("long") for c in dataset.longs})
        .withColumn(
            "reject_reason",
            F.when(problem.isNotNull(), F.concat(F.lit("archive is unreadable: "), problem))
            .when(F.col(BAD_LINE).isNotNull(), "line is no JSON object")
            .when(seconds.isNull(), "timestamp is missing or invalid")
            .otherwise(reason),
        )
        .withColumns({"datetime": datetime_or_iso(F.col("datetime"), seconds), "date": utc_date(seconds)})
    )


def checked(lines: DataFrame, dataset: Dataset) -> DataFrame:
    """All lines with the table's columns, ``reject_reason`` (NULL for a good line) and the bad ``line``."""
    return _typed(lines, dataset).select(*dataset.columns, "reject_reason", F.col(BAD_LINE).alias("line"))


def write_checked(
    lines: DataFrame, dataset: Dataset, table: str, rejects: str, seen: Observation, strict: bool = False, fmt: str = "parquet"
) -> None:
    """Accepted lines to ``table`` in order, rejected ones with their reason to ``rejects``.

    One pass over ``lines`` parses them and tells ``seen`` how many there are of each; the tables are laid out from what
    it wrote. ``strict`` fails on the first bad line.
    """
    bad = F.col("reject_reason").isNotNull()
    rows = checked(lines, dataset)
    if strict:
        stop = F.raise_error(F.concat_ws(": ", "source_path", "reject_reason"))
        rows = rows.where(F.when(bad, stop).otherwise(True))
    rows = rows.observe(seen, F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"))
    staging = f"{table.rstrip('/')}__staged"
    good, rest = staged_split(rows.withColumn("rejected", bad), "rejected", staging)
    write_sorted(good, table, dataset.order, list(dataset.columns), fmt)
    write_table(rest, rejects, ["source_path", "reject_reason", "line"])
    drop_folder(lines.sparkSession, staging)


def accepted(lines: DataFrame, dataset: Dataset, strict: bool = False) -> DataFrame:
    reason = F.col("reject_reason")
    keep = reason.isNull()
    if strict:
        keep = F.when(keep, True).otherwise(F.raise_error(F.concat_ws(": ", "source_path", reason)))
    return _typed(lines, dataset).where(keep).select(*dataset.columns)


def rejected(lines: DataFrame, dataset: Dataset) -> DataFrame:
    bad = _typed(lines, dataset).where(F.col("reject_reason").isNotNull())
    return bad.select("source_path", "reject_reason", F.col(BAD_LINE).alias("line"))


def clean_market_data(lines: DataFrame, strict: bool = False) -> DataFrame:
    return accepted(lines, MARKET_DATA, strict)


def clean_underlying(lines: DataFrame, strict: bool = False) -> DataFrame:
    return accepted(lines, UNDERLYING, strict)


def clean_settlement(lines: DataFrame, strict: bool = False) -> DataFrame:
    return accepted(lines, SETTLEMENT, strict)


def clean_ohlcv_1d(lines: DataFrame, strict: bool = False) -> DataFrame:
    return accepted(lines, OHLCV_1D, strict)


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table; over Parquet this reads the footers only."""
    counts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in tables.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out
