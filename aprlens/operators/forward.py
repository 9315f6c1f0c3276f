"""Forward averages: mean of a pair's daily rates over [date, end] for very many intervals.

A range join would emit every day of every interval. Instead daily rates become running totals and an
interval costs two equality lookups: the total through its end minus the total before its start.

The lookup table has one page per pair and calendar month. A page holds the totals after each day of the
month, so a lookup is an array access, and months without a rate repeat the last total. Its size follows
pairs and months, not observations. Spark broadcasts it where it is small enough and otherwise shuffles both
sides by (exchange, asset, month); skew-join splitting then takes care of a hot pair.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timing import as_date
from .scan import running_sums

PAIR = ["exchange", "asset"]
DAY_SLOTS = 32


def forward_prefix(underlying_daily: DataFrame) -> DataFrame:
    """Running sum and count of the daily rates of each pair, on the days that have one.

    The window holds one row per day of a pair, however many observations were behind it.
    """
    running = Window.partitionBy(*PAIR).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        underlying_daily.where(F.col("realizedApr").isNotNull())
        .select(*PAIR, "date", "realizedApr")
        .withColumn("rateSum", F.sum("realizedApr").over(running))
        .withColumn("rateDays", F.count("realizedApr").over(running))
    )


def forward_prefix_by_month(underlying_daily: DataFrame) -> DataFrame:
    """:func:`forward_prefix` for rates of any frequency: months are summed apart and carried on, so that no task needs a
    whole pair."""
    rows = underlying_daily.where(F.col("realizedApr").isNotNull()).select(*PAIR, "date", "realizedApr")
    counted = {"rateSum": F.col("realizedApr"), "rateDays": F.lit(1).cast("long")}
    return running_sums(rows, PAIR, ["date"], F.trunc("date", "month"), counted)


def month_pages(underlying_daily: DataFrame) -> DataFrame:
    """Per pair and month with a rate: totals within the month after each of its days (slot n; slot 0 is zero).

    A page depends on its own month only, so that a late day changes one page. The window holds the days of a month.
    """
    running = Window.partitionBy(*PAIR, "month").orderBy("date")
    rows = (
        underlying_daily.where(F.col("realizedApr").isNotNull())
        .select(*PAIR, F.trunc("date", "month").alias("month"), "date", "realizedApr")
        .withColumn("sum", F.sum("realizedApr").over(running.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.row_number().over(running))
        .withColumn("next", F.lead("date").over(running))
    )
    entry = F.expr(f"struct(dayofmonth(date) AS day, coalesce(datediff(next, date), {DAY_SLOTS} - dayofmonth(date)) AS span, sum, n)")
    months = rows.groupBy(*PAIR, "month").agg(F.sort_array(F.collect_list(entry)).alias("e"))  # 31 entries at most

    def page(field: str, zero: str) -> str:
        return f"concat(array_repeat({zero}, e[0].day), flatten(transform(e, x -> array_repeat(x.{field}, x.span))))"

    return months.selectExpr(*PAIR, "month", f"{page('sum', '0D')} AS sums", f"{page('n', '0')} AS days")


def carried_pages(pages: DataFrame, through: Column) -> DataFrame:
    """:func:`month_pages` on top of the totals of the months before, and a page for each month without a rate, up to the
    last rate or ``through``. The window holds one row per month of a pair."""
    by_month = Window.partitionBy(*PAIR).orderBy("month")
    before = by_month.rowsBetween(Window.unboundedPreceding, -1)
    carried = pages.withColumns(
        {
            "sumBefore": F.coalesce(F.sum(F.element_at("sums", -1)).over(before), F.lit(0.0)),
            "daysBefore": F.coalesce(F.sum(F.element_at("days", -1)).over(before), F.lit(0)),
            "until": F.coalesce(
                F.add_months(F.lead("month").over(by_month), -1), F.greatest("month", F.trunc(through, "month"))
            ),
        }
    )
    months = carried.selectExpr("*", "explode(sequence(month, until, INTERVAL 1 MONTH)) AS at")

    def page(field: str, before: str) -> str:
        last = f"array_repeat({before} + element_at({field}, -1), {DAY_SLOTS})"
        return f"IF(at = month, transform({field}, x -> {before} + x), {last})"

    return months.selectExpr(*PAIR, "at AS month", f"{page('sums', 'sumBefore')} AS sums", f"{page('days', 'daysBefore')} AS days")


def rate_pages(underlying_daily: DataFrame, through: Column) -> DataFrame:
    """``sums`` and ``days`` of every pair and month, from its first rate to its last or ``through``.

    Slot 0 is the total before the month, slot n the total after its n-th day.
    """
    return carried_pages(month_pages(underlying_daily), through)


def _look_up(rows: DataFrame, pages: DataFrame, day: str, *values: str) -> DataFrame:
    """Add ``values``, SQL over the page that holds ``day``; NULL where there is none."""
    joined = rows.withColumn("month", F.trunc(day, "month")).join(pages, [*PAIR, "month"], "left")
    return joined.selectExpr(*rows.columns, *values)


def with_forward_average(
    rows: DataFrame, underlying_daily: DataFrame, as_of: Column | dt.date | str | None = None
) -> DataFrame:
    """Add to rows of (exchange, asset, date, maturity) the mean rate from that day until maturity.

    ``realizedForwardApr`` and ``forwardDaysUsed`` cover the days with a rate in [date, min(maturity, as_of)]:
    NULL and 0 where there is none or no maturity.
    """
    as_of = as_date(as_of)
    return with_paged_average(rows, rate_pages(underlying_daily, as_of), as_of)


def with_paged_average(rows: DataFrame, pages: DataFrame, as_of: Column | dt.date | str | None = None) -> DataFrame:
    """The same from pages that are kept. Both look-ups ask for the same fields of the pages, so that Spark builds and
    sends them once."""
    as_of = as_date(as_of)
    rows = rows.withColumn("forwardEnd", F.when(F.col("maturity").isNotNull(), F.least("maturity", as_of)))
    kept = rows.columns
    rows = _look_up(
        rows,
        pages,
        "date",
        "get(sums, dayofmonth(date) - 1) AS sumBefore",
        "get(days, dayofmonth(date) - 1) AS daysBefore",
    )
    rows = _look_up(
        rows,
        pages,
        "forwardEnd",
        "get(sums, dayofmonth(forwardEnd)) AS sumThrough",
        "IF(forwardEnd >= date, greatest(get(days, dayofmonth(forwardEnd)) - coalesce(daysBefore, 0), 0), 0) AS used",
    )
    return rows.selectExpr(
        *kept,
        "coalesce(used, 0) AS forwardDaysUsed",
        "IF(used > 0, (sumThrough - coalesce(sumBefore, 0)) / used, NULL) AS realizedForwardApr",
    )


def touched_by(rows: DataFrame, changed: DataFrame, as_of: Column | dt.date | str | None = None) -> DataFrame:
    """Rows of (exchange, asset, date, maturity) that a change of the rates of ``changed`` (exchange, asset, date) concerns:
    those whose day, or a day between it and min(maturity, as_of), is among them.

    The changed days of a pair are laid out in pages like rates, so that an interval asks for their count by two look-ups.
    """
    days = changed.select(*PAIR, "date").distinct()
    of_pairs = rows.join(days.select(*PAIR).distinct(), PAIR, "left_semi")
    counted = with_forward_average(of_pairs, days.withColumn("realizedApr", F.lit(1.0)), as_of)
    same_day = days.select(*PAIR, "date", F.lit(True).alias("sameDay"))
    hit = counted.join(same_day, [*PAIR, "date"], "left").where("forwardDaysUsed > 0 OR sameDay")
    return hit.select(*rows.columns)
