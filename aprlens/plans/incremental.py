"""Keeps clean tables, daily tables, rate pages, the comparison and the gap board up to date as archives arrive.

An update costs what arrived, not what is there. New archives become a batch of clean lines; a batch is reduced to partial
sums per key and day, which are kept by month and batch; only months with new partials are merged again. A late day of
rates rewrites the page of its month and the comparison's rows whose forward window holds it: these are found by asking
each row's window for the count of changed days, and the months they lie in are written again, all other rows of those
months as they were.

Every step replaces what an earlier attempt of it left (a batch's folder, a batch's partials, a month), and a batch is
entered as applied when all is written. An update that failed is simply run again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timing import as_date
from ..operators import compare, daily, forward, views
from ..sources.tables import MONTH, month_of, read_months, read_or_none, write_months, write_table
from ..streaming import ingest
from .pipeline import CLEAN_TABLES, Counts

# Which daily table follows from which clean table.
DAILY_TABLES = {
    "market_data": ("market_daily_apr", daily.MARKET_DAYS),
    "underlying_apr": ("underlying_daily_apr", daily.UNDERLYING_DAYS),
    "settlement": ("settlement_daily_apr", daily.SETTLEMENT_DAYS),
}
APPLIED_SCHEMA = "name string, batch long, as_of date"
COMPARISON = "apr_comparison_daily"


def ingest_new(spark: SparkSession, raw_root: str, out: str, strict: bool = False) -> dict[str, Counts]:
    """Clean the archives that landed since the last time; returns the counts of the batches this added."""
    counts = {}
    for name, dataset in CLEAN_TABLES.items():
        table = f"{out}/{name}"
        before = ingest.batches_of(spark, table)
        ingest.append_new(spark, raw_root, dataset, table, f"{out}/checkpoints/{name}", strict).awaitTermination()
        new = ingest.ledger(spark, table).where(~F.col("batch").isin(before))
        sums = new.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("accepted", "rejected")]).first()
        counts[name] = Counts(*sums)
    return counts


def _applied(spark: SparkSession, out: str) -> DataFrame:
    found = read_or_none(spark, f"{out}/applied")
    return spark.createDataFrame([], APPLIED_SCHEMA) if found is None else found


def months_in(rows: DataFrame, day: str = "date") -> list[dt.date]:
    """The months of ``rows``: at most one value for each month of the data."""
    return sorted(r[0] for r in rows.select(month_of(day)).distinct().collect())


def add_partials(spark: SparkSession, out: str, name: str, batch: int) -> None:
    """The partial sums of one batch of a clean table, in the place of those an earlier attempt left."""
    kind = DAILY_TABLES[name][1]
    parts = daily.partials(ingest.accepted_lines(spark, CLEAN_TABLES[name], f"{out}/{name}", [batch]), kind)
    write_months(parts.withColumn("batch", F.lit(batch)), f"{out}/{name}_partials", kind.days, within=["batch"])


def _partials(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    schema = f"{DAILY_TABLES[name][1].partial_schema}, {MONTH} date, batch long"
    return read_or_none(spark, f"{out}/{name}_partials", schema)


def new_days(spark: SparkSession, out: str, name: str, batches: list[int]) -> DataFrame:
    """Keys and days that the batches have lines of; from their partials alone."""
    kind = DAILY_TABLES[name][1]
    parts = _partials(spark, out, name) if batches else None
    if parts is None:
        return spark.createDataFrame([], ", ".join([*[f"{k} string" for k in kind.keys], "date date"]))
    return parts.where(F.col("batch").isin(batches)).select(*kind.days).distinct()


def days_of_months(spark: SparkSession, out: str, name: str, months: list[dt.date]) -> DataFrame:
    """The daily table's rows of some months, from all batches' partials of these months; no other folder is read."""
    return daily.merged(_partials(spark, out, name).where(F.col(MONTH).isin(months)), DAILY_TABLES[name][1])


def _stored(spark: SparkSession, out: str, table: str, months: list[dt.date], columns: str) -> DataFrame:
    found = read_or_none(spark, f"{out}/{table}")
    if found is None:
        return spark.createDataFrame([], columns)
    return found.where(F.col(MONTH).isin(months)).drop(MONTH)


def apply_new(spark: SparkSession, out: str, as_of: dt.date | str | None = None) -> dict[str, list[dt.date]]:
    """Bring daily tables, rate pages and comparison up to the batches in the ledgers; returns the months rewritten.

    ``as_of`` may move between updates; rows whose window gains or loses days by it are compared again, too.
    """
    today = dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of or dt.date.today()
    applied = _applied(spark, out).collect()  # a row per batch and table
    done = {(r["name"], r["batch"]) for r in applied}
    last = max((r["as_of"] for r in applied), default=today) if applied else today
    waiting = {n: [b for b in ingest.batches_of(spark, f"{out}/{n}") if (n, b) not in done] for n in DAILY_TABLES}
    written: dict[str, list[dt.date]] = {}
    for name, batches in waiting.items():
        table, kind = DAILY_TABLES[name]
        for batch in batches:
            add_partials(spark, out, name, batch)
        written[table] = months_in(new_days(spark, out, name, batches))
        if written[table]:
            write_months(days_of_months(spark, out, name, written[table]), f"{out}/{table}", kind.days)

    rates = "underlying_daily_apr"
    if written[rates]:
        pages = forward.month_pages(read_months(spark, f"{out}/{rates}", written[rates]))
        write_months(pages, f"{out}/rate_pages", forward.PAIR, day=MONTH)
    written[COMPARISON] = _update_comparison(spark, out, waiting, today, last)
    entries = [(n, b, today) for n, batches in waiting.items() for b in batches] or [("", -1, today)]
    spark.createDataFrame(entries, APPLIED_SCHEMA).coalesce(1).write.mode("append").parquet(f"{out}/applied")
    return written


def _update_comparison(
    spark: SparkSession, out: str, waiting: dict[str, list[int]], today: dt.date, last: dt.date
) -> list[dt.date]:
    market_days = read_or_none(spark, f"{out}/market_daily_apr")
    if market_days is None:
        return []
    changed_markets = new_days(spark, out, "market_data", waiting["market_data"]).unionByName(
        new_days(spark, out, "settlement", waiting["settlement"])
    )
    changed_rates = new_days(spark, out, "underlying_apr", waiting["underlying_apr"])
    rates = read_or_none(spark, f"{out}/underlying_daily_apr")
    if rates is not None and today != last:
        between = rates.where(F.col("date") > min(today, last)).where(F.col("date") <= max(today, last))
        changed_rates = changed_rates.unionByName(between.select(*forward.PAIR, "date"))
    stale = compare.stale_rows(market_days, changed_markets, changed_rates, as_date(max(today, last).isoformat()))
    write_table(stale, f"{out}/stale_rows")
    stale = spark.read.parquet(f"{out}/stale_rows")
    months = months_in(stale)
    if not months:
        return []
    rate_columns = "exchange string, asset string, date date, samples long, realizedApr double"
    settled_columns = "market string, date date, samples long, settlementApr double"
    days = (
        read_months(spark, f"{out}/market_daily_apr", months),
        _stored(spark, out, "underlying_daily_apr", months, rate_columns),
        _stored(spark, out, "settlement_daily_apr", months, settled_columns),
    )
    pages = read_or_none(spark, f"{out}/rate_pages")
    if pages is None:
        pages = forward.month_pages(days[1].limit(0))
    through = as_date(today.isoformat())
    pages = forward.carried_pages(pages, through)
    old = read_or_none(spark, f"{out}/{COMPARISON}")
    if old is None:
        fresh = compare.apr_comparison(*days, today.isoformat(), pages)
    else:
        old = old.where(F.col(MONTH).isin(months)).drop(MONTH)
        fresh = compare.refreshed(old, stale, *days, today.isoformat(), pages)
    write_months(fresh, f"{out}/{COMPARISON}", ["market", "date"])
    gaps = views.gap_partials(read_months(spark, f"{out}/{COMPARISON}", months))
    write_months(gaps, f"{out}/gap_partials", ["market"], day=MONTH)
    return months


def update(
    spark: SparkSession, raw_root: str, out: str, as_of: dt.date | str | None = None, strict: bool = False
) -> tuple[dict[str, Counts], dict[str, list[dt.date]]]:
    """Ingest and apply what is new; returns the counts of new lines and the months each table was rewritten in."""
    return ingest_new(spark, raw_root, out, strict), apply_new(spark, out, as_of)


def gap_board(spark: SparkSession, out: str) -> DataFrame:
    """The market board, from a row per market and month."""
    return views.board_of(spark.read.parquet(f"{out}/gap_partials"))


def drilldown(spark: SparkSession, out: str, wanted: str | None = None, **filters) -> DataFrame:
    """The comparison's days of the market that the filters of the board choose: its file ranges alone are read."""
    chosen = views.select_market(gap_board(spark, out), wanted, **filters).first()
    days = spark.read.parquet(f"{out}/{COMPARISON}").drop(MONTH)
    return days.where(F.col("market") == chosen["market"]) if chosen else days.limit(0)


def clean_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    return ingest.accepted_lines(spark, CLEAN_TABLES[name], f"{out}/{name}")


def all_rejected(spark: SparkSession, out: str) -> DataFrame:
    """``name, batch, source_path, reject_reason, line`` of every line no clean table has."""
    parts = [ingest.rejected_lines(spark, f"{out}/{n}").select(F.lit(n).alias("name"), "*") for n in CLEAN_TABLES]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
