"""Every registered query, each over the whole of the tables it names."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import markets as mk
from ..functions import numeric as nm
from ..functions import timing as tm
from ..operators import charts, clean, compare, cross, daily, dashboard, forward, order, scan, site, views
from ..sources import manifest as mf
from .adapters import AS_OF, KEYS, candles_in, funding, settlements, snapshots, symbol, table, venue

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals and -0.0 to 0.0, so that two engines print the same number."""
    return df.selectExpr(*[f"{nm.rounded_text(c)} + 0.0D AS {c}" if kind == "double" else c for c, kind in df.dtypes])


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(function(spark, sf))

    REGISTRY[function.__name__] = run
    return function


# --- files ---------------------------------------------------------------------------------------------------


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(path.alias("path"), F.col("n_chars").alias("size"), "doc_id")


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("doc_id") % 3
    return _manifest(spark, sf).where(turn < 2).select("path", (F.col("size") + turn).alias("size"))


PREFIXES = ["src1", "src2/", "src7"]


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    return mf.select_files(_manifest(spark, sf).select("path", "size"), include=PREFIXES)


@query
def select_files(spark, sf):
    return _wanted(spark, sf)


@query
def pending_files(spark, sf):
    return mf.pending_files(_wanted(spark, sf), _landed(spark, sf))


@query
def transfer_summary(spark, sf):
    return mf.transfer_summary(_wanted(spark, sf), _landed(spark, sf))


# --- expressions ---------------------------------------------------------------------------------------------


@query
def market_meta(spark, sf):
    return mk.with_market_columns(snapshots(spark, sf).select("market").distinct())


@query
def underlying_key(spark, sf):
    rows = (
        table(spark, sf, "orders")
        .selectExpr("*", f"o_custkey % {KEYS} AS k")
        .selectExpr("o_orderkey", "o_orderpriority", f"{venue('k')} AS venue", f"{symbol('k')} AS symbol")
    )
    plain = f"concat_ws('-', {mk.exchange_name('venue')}, symbol)"
    coded = "concat_ws('-', venue, lower(symbol), left(o_orderpriority, 1))"
    stems = rows.selectExpr(f"IF(o_orderkey % 2 = 0, {plain}, {coded}) AS stem")
    counted = stems.groupBy("stem").agg(F.count(F.lit(1)).alias("files"))
    return counted.selectExpr("stem", f"{mk.funding_exchange('stem')} AS exchange", f"{mk.funding_asset('stem')} AS asset", "files")


def _number_text(event_id: Column, value: Column) -> Column:
    """The value written in ways a number may and may not be written."""
    hundredths = F.round(value * 100).cast("long").cast("string")
    return (
        F.when(event_id % 8 == 0, F.lit(""))
        .when(event_id % 8 == 1, F.concat(F.lit(" "), hundredths, F.lit(" ")))
        .when(event_id % 8 == 2, F.concat(F.lit("1_"), hundredths))
        .when(event_id % 8 == 3, F.concat(hundredths, F.lit("d")))
        .when(event_id % 8 == 4, F.lit("nan"))
        .when(event_id % 8 == 5, F.lit("-Infinity"))
        .when(event_id % 8 == 6, F.concat(hundredths, F.lit("e-2")))
        .otherwise(F.concat(F.lit("x"), hundredths))
    )


@query
def numeric_coercion(spark, sf):
    text = _number_text(F.col("event_id"), F.col("value"))
    number = nm.permissive_double(F.col("text"))
    return table(spark, sf, "events").select("event_id", text.alias("text")).select(
        "event_id",
        F.when(F.isnan(number), "nan").when(F.abs(number) == float("inf"), "inf").when(number.isNotNull(), "number").alias("kind"),
        nm.finite_double(F.col("text")).alias("value"),
    )


@query
def epoch_fields(spark, sf):
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return (
        table(spark, sf, "events")
        .select("event_id", F.timestamp_diff("SECOND", start, "ts").alias("seconds"), F.when(F.col("event_id") % 3 == 0, "event_type").otherwise("").alias("text"))
        .select(
            "event_id",
            "seconds",
            tm.utc_date(F.col("seconds")).alias("date"),
            tm.iso_utc(F.col("seconds")).alias("iso"),
            tm.datetime_or_iso(F.col("text"), F.col("seconds")).alias("datetime"),
        )
    )


# --- cleaning ------------------------------------------------------------------------------------------------


def _as_lines(df: DataFrame, dataset: clean.Dataset, path: Column, datetime: Column) -> DataFrame:
    """Rows written as the JSON lines an archive holds, and read back; spread first, as a table may lie in one row group."""
    df = df.repartition(*df.columns)
    have = [c for c in df.columns if c in (*dataset.number_fields, *dataset.texts)]
    record = F.to_json(F.struct(*have, datetime.alias("datetime")))
    return clean.lines_of(df.select(path.alias("source_path"), record.cast("binary").alias("block")), dataset)


def _market_path(prefix: str) -> Column:
    return F.concat(F.lit(prefix + "/"), F.col("market"), F.lit("/"), F.year("date").cast("string"), F.lit(".ndjson.zip"))


def _sometimes_dated() -> Column:
    return F.when(F.col("blockNumber") % 2 == 0, F.concat(F.lit("block "), F.col("blockNumber").cast("string"))).otherwise("")


@query
def clean_market_data(spark, sf):
    lines = _as_lines(snapshots(spark, sf), clean.MARKET_DATA, _market_path("market-data"), _sometimes_dated())
    return clean.clean_market_data(lines)


@query
def clean_underlying(spark, sf):
    rows = funding(spark, sf).withColumn("timestamp", F.unix_date("date").cast("long") * 86400)
    path = F.concat(F.lit("underlying-apr/"), F.col("exchange"), F.lit("-"), F.lower("asset"), F.lit(".ndjson.zip"))
    return clean.clean_underlying(_as_lines(rows, clean.UNDERLYING, path, F.lit("")))


@query
def clean_settlement(spark, sf):
    lines = _as_lines(settlements(spark, sf), clean.SETTLEMENT, _market_path("settlement"), _sometimes_dated())
    return clean.clean_settlement(lines)


@query
def clean_ohlcv(spark, sf):
    rows = candles_in(spark, sf).withColumn("periodStartTimestamp", F.unix_date("date").cast("long") * 86400)
    return clean.clean_ohlcv_1d(_as_lines(rows, clean.OHLCV_1D, _market_path("ohlcv/1d"), F.lit("")))


@query
def rejected_lines(spark, sf):
    """Rejects by archive and reason, of snapshots with planted faults: lines that are no object, no date, no market."""
    number = F.col("blockNumber")
    rows = snapshots(spark, sf).select("market", "date", "blockNumber", "midApr", "timestamp")
    record = F.to_json(F.struct("midApr", F.when(number % 7 != 0, F.col("timestamp")).alias("timestamp")))
    line = F.when(number % 5 == 0, F.concat(F.lit("line "), number.cast("string"))).when(number % 11 == 0, "[1]").otherwise(record)
    path = F.when(number % 13 == 0, "market-data/7-OKX-BTCUSDT-31FEB2024/x.ndjson.zip").otherwise(_market_path("market-data"))
    blocks = rows.select(path.alias("source_path"), line.cast("binary").alias("block"))
    found = clean.rejected(clean.lines_of(blocks, clean.MARKET_DATA), clean.MARKET_DATA)
    return found.groupBy("source_path", "reject_reason").agg(F.count(F.lit(1)).alias("lines"), F.count("line").alias("kept"))


@query
def table_row_counts(spark, sf):
    tables = {
        "market_data": snapshots(spark, sf),
        "underlying_apr": funding(spark, sf),
        "settlement": settlements(spark, sf),
        "ohlcv_1d": candles_in(spark, sf),
    }
    return clean.table_row_counts(tables)


# --- daily tables and the comparison -------------------------------------------------------------------------


def _comparison(spark: SparkSession, sf: str, kept: DataFrame | None = None) -> DataFrame:
    """The comparison, of the markets in ``kept`` only where given: lines of others are not even aggregated."""
    if kept is None:
        lines, settled = snapshots(spark, sf), settlements(spark, sf)
    else:
        lines = snapshots(spark, sf).join(kept, "market", "left_semi")
        settled = settlements(spark, sf).join(kept, "market", "left_semi")
    days = (
        daily.market_daily(lines), daily.underlying_daily(funding(spark, sf)), daily.settlement_rates(settled)
    )
    return compare.comparison_with_samples(*(days if kept is None else compare.restricted(*days, kept)), AS_OF)


@query
def market_daily(spark, sf):
    return daily.market_daily(snapshots(spark, sf))


@query
def market_daily_events(spark, sf):
    """Event values as snapshots: several a day, some of them not finite."""
    value = F.col("value") / 5003
    mid = F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(value)
    key = f"user_id % {KEYS}"
    market = F.expr(f"concat_ws('-', {key}, {venue(key)}, {symbol(key)}, '29MAR2024')")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts")
    rows = table(spark, sf, "events").select(
        market.alias("market"),
        tm.utc_date(seconds).alias("date"),
        mid.alias("midApr"),
        F.when(F.col("event_type") == "click", value).alias("markApr"),
        value.cast("string").alias("ammImpliedApr"),
        F.lit(None).cast("double").alias("latestSettlementApr"),
        (value * 2).alias("notionalOI"),
    )
    return daily.market_daily(rows)


@query
def underlying_daily(spark, sf):
    return daily.underlying_daily(funding(spark, sf))


@query
def settlement_daily(spark, sf):
    return daily.settlement_daily(settlements(spark, sf))


def _merged_days(kind: daily.DailyTable, batches: list[DataFrame]) -> DataFrame:
    """The daily table out of the partials of batches, the first two of which were added up before."""
    parts = [daily.partials(b, kind) for b in batches]
    kept = daily.added(parts[0].unionByName(parts[1]), kind)
    return daily.merged(kept.unionByName(parts[2]), kind)


@query
def market_daily_merged(spark, sf):
    rows = snapshots(spark, sf)
    return _merged_days(daily.MARKET_DAYS, [rows.where(F.col("blockNumber") % 3 == k) for k in range(3)])


@query
def underlying_daily_merged(spark, sf):
    rows = funding(spark, sf)
    third = F.pmod(F.xxhash64("annualizedFundingRate"), F.lit(3))
    return _merged_days(daily.UNDERLYING_DAYS, [rows.where(third == k) for k in range(3)])


@query
def settlement_daily_merged(spark, sf):
    rows = settlements(spark, sf)
    return _merged_days(daily.SETTLEMENT_DAYS, [rows.where(F.col("blockNumber") % 3 == k) for k in range(3)])


LATE, ON_TIME = ("day(date) = 15 AND month(date) % 4 = 0", "NOT (day(date) = 15 AND month(date) % 4 = 0)")


@query
def stale_rows(spark, sf):
    """The comparison's rows that rates of late days concern."""
    late = funding(spark, sf).where(LATE).where("asset IN ('BTC', 'ETH')")
    days = daily.market_daily(snapshots(spark, sf))
    return compare.stale_rows(days, days.where("samples > 2"), late, AS_OF)


@query
def apr_comparison_refreshed(spark, sf):
    """The comparison as it was before the late days' rates and settlements came, brought up to date."""
    lines, rates, settled = snapshots(spark, sf), funding(spark, sf), settlements(spark, sf)
    market_days = daily.market_daily(lines)
    before = compare.apr_comparison(
        market_days, daily.underlying_daily(rates.where(ON_TIME)), daily.settlement_rates(settled.where(ON_TIME)), AS_OF
    )
    stale = compare.stale_rows(market_days, settled.where(LATE), rates.where(LATE), AS_OF)
    pages = forward.carried_pages(forward.month_pages(daily.underlying_daily(rates)), tm.as_date(AS_OF))
    days = (market_days, daily.underlying_daily(rates), daily.settlement_rates(settled))
    return compare.refreshed(before, stale, *days, AS_OF, pages)


@query
def forward_prefix(spark, sf):
    return forward.forward_prefix(daily.underlying_daily(funding(spark, sf)))


@query
def forward_prefix_by_month(spark, sf):
    return forward.forward_prefix_by_month(daily.underlying_daily(funding(spark, sf)))


@query
def running_line_values(spark, sf):
    """Running sums over single lines, not days: every tenth of a market's values is missing."""
    value = F.when(F.col("blockNumber") % 10 != 0, F.col("midApr") - F.col("markApr"))
    rows = snapshots(spark, sf).select("market", "date", "blockNumber", value.alias("diff"))
    rows = rows.groupBy("market", "date", "blockNumber").agg(F.sum("diff").alias("diff"))
    sums = {"sum": F.col("diff"), "values": F.when(F.col("diff").isNotNull(), 1)}
    return scan.running_sums(rows, ["market"], ["date", "blockNumber"], F.trunc("date", "month"), sums)


@query
def forward_average(spark, sf):
    days = mk.with_market_columns(snapshots(spark, sf).select("market", "date").distinct())
    rates = daily.underlying_daily(funding(spark, sf))
    out = forward.with_forward_average(compare.with_daily_realized(days, rates), rates, AS_OF)
    return out.select("market", "date", "forwardEnd", "realizedDailyApr", "realizedForwardApr", "forwardDaysUsed")


@query
def daily_realized(spark, sf):
    rows = compare.with_daily_realized(daily.market_daily(snapshots(spark, sf)), daily.underlying_daily(funding(spark, sf)))
    return rows.select("market", "date", "exchange", "asset", "samples", "realizedDailyApr")


@query
def daily_settlement(spark, sf):
    rows = compare.with_settlement(daily.market_daily(snapshots(spark, sf)), daily.settlement_rates(settlements(spark, sf)))
    return rows.select("market", "date", "samples", "settlementApr", "settlementSamples")


@query
def apr_comparison(spark, sf):
    return _comparison(spark, sf).drop("settlementSamples")


# --- dashboard -----------------------------------------------------------------------------------------------


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.market_summary(_comparison(spark, sf))


@query
def market_summary(spark, sf):
    return dashboard.ranked_summary(_summary(spark, sf))


@query
def market_summary_top24(spark, sf):
    return dashboard.top_markets(_summary(spark, sf))


@query
def market_list(spark, sf):
    return dashboard.market_list(_summary(spark, sf))


@query
def heatmap(spark, sf):
    return dashboard.heatmap(_summary(spark, sf))


@query
def heat_intensity(spark, sf):
    return dashboard.heat_intensity(dashboard.heatmap(_summary(spark, sf)))


@query
def dashboard_bounds(spark, sf):
    return dashboard.dashboard_bounds(_summary(spark, sf))


@query
def market_series(spark, sf):
    return dashboard.market_series(_comparison(spark, sf))


# --- site ----------------------------------------------------------------------------------------------------


def _series(spark: SparkSession, sf: str, kept: DataFrame | None = None) -> DataFrame:
    return site.compact_series(_comparison(spark, sf, kept))


def _candles(spark: SparkSession, sf: str) -> DataFrame:
    return site.candle_series(candles_in(spark, sf))


def _last_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Last day of the comparison, which has every day of the snapshots: a scan of one column."""
    return snapshots(spark, sf).agg(F.max("date").alias("sourceDateMax"))


def _site_summary(spark: SparkSession, sf: str) -> DataFrame:
    return site.site_summary(_series(spark, sf), _candles(spark, sf), _last_snapshot(spark, sf))


@query
def site_summary(spark, sf):
    return _site_summary(spark, sf)


@query
def site_bounds(spark, sf):
    return site.site_bounds(_series(spark, sf))


@query
def daily_corr(spark, sf):
    rows = _series(spark, sf).groupBy("market").agg(
        F.count(F.lit(1)).alias("rows"), nm.pearson(F.col("i"), F.col("rd")).alias("corr")
    )
    return rows


@query
def basis_percentiles(spark, sf):
    points = nm.quantiles(F.col("fb"), [0.1, 0.5, 0.9])
    return (
        _series(spark, sf)
        .groupBy("market")
        .agg(points.alias("points"), nm.spread(F.col("fb")).alias("basisVol"))
        .select("market", *[F.col("points")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "basisVol")
    )


@query
def line_percentiles(spark, sf):
    """Percentiles and the mode of single lines' open interest by asset: groups no calendar bounds."""
    rows = mk.with_market_columns(snapshots(spark, sf).select("market", "notionalOI"))
    counts = order.value_counts(rows, ["asset"], F.col("notionalOI"))
    points = order.percentiles(counts, ["asset"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    modes = order.modes(counts, ["asset"]).withColumnRenamed("asset", "_asset")
    return points.join(modes, F.col("asset").eqNullSafe(F.col("_asset"))).drop("_asset")


@query
def settlement_mode(spark, sf):
    return _series(spark, sf).groupBy("market").agg(nm.smallest_mode(F.col("ss")).alias("settlementSamplesPerDay"))


@query
def volume_stats(spark, sf):
    return site.volume_stats(_candles(spark, sf))


@query
def candle_days(spark, sf):
    """Single lines as candles within a day, made one a market and day; lines of one order are states of one candle."""
    lines = snapshots(spark, sf).withColumnsRenamed({"midApr": "open", "bestAsk": "high", "bestBid": "low"})
    lines = lines.withColumnsRenamed({"markApr": "close", "notionalOI": "volume", "blockNumber": "periodStartTimestamp"})
    return site.daily_candles(site.candle_series(lines))


@query
def compact_series(spark, sf):
    return _series(spark, sf)


@query
def settlement_samples(spark, sf):
    """Settlement counts looked up for a comparison that does not carry them."""
    settled = daily.settlement_rates(settlements(spark, sf))
    rows = daily.market_daily(snapshots(spark, sf)).select("market", "date", "samples")
    return site.with_settlement_samples(rows, settled)


@query
def underlying_series(spark, sf):
    return site.underlying_series(daily.underlying_daily(funding(spark, sf)))


def _payload(spark: SparkSession, sf: str) -> DataFrame:
    return site.market_payload(_site_summary(spark, sf), _series(spark, sf), _candles(spark, sf))


@query
def payload_flat(spark, sf):
    """The nested payload taken apart again: position and values of each day, and what the market has beside."""
    return _payload(spark, sf).select(
        "market",
        F.col("summary.rows").alias("rows"),
        F.size("ohlcv").cast("long").alias("candles"),
        F.posexplode("series").alias("pos", "day"),
    ).select("market", "rows", "candles", F.col("pos").cast("long").alias("pos"), "day.*")


@query
def payload_candles(spark, sf):
    return _payload(spark, sf).select("market", F.posexplode("ohlcv").alias("pos", "candle")).select(
        "market", F.col("pos").cast("long").alias("pos"), "candle.*"
    )


# --- views ---------------------------------------------------------------------------------------------------


def _board(spark: SparkSession, sf: str, **filters) -> DataFrame:
    """The board; with filters on what a market's name says, of those markets only."""
    kept = views.kept_markets(snapshots(spark, sf), **filters) if filters else None
    return views.market_board(_series(spark, sf, kept))


@query
def gap_sum(spark, sf):
    return _board(spark, sf)


@query
def gap_board_merged(spark, sf):
    """The board out of partial sums by month."""
    return views.board_of(views.gap_partials(_comparison(spark, sf)))


@query
def gap_label(spark, sf):
    return views.with_gap_label(_board(spark, sf)).select("market", "avgForwardBasis", "gapLabel", "gapClass")


@query
def gap_rank(spark, sf):
    ranked = views.rank_by_gap(_board(spark, sf))
    return ranked.select("market", "exchange", "asset", "maturity", "gapSum", views.gap_size().alias("gapSize"))


@query
def largest_gap(spark, sf):
    return views.largest_gap(_board(spark, sf)).select("market", "exchange", "asset", "maturity", "gapSum")


@query
def filtered_markets(spark, sf):
    return views.rank_by_gap(_board(spark, sf, exchange="Binance", asset="BTC"))


@query
def filtered_maturity(spark, sf):
    return views.rank_by_gap(_board(spark, sf, maturity="1998-03-31"))


@query
def lens_paid(spark, sf):
    return views.rank_by_gap(views.filter_markets(_board(spark, sf), lens="paid"))


@query
def lens_received(spark, sf):
    return views.rank_by_gap(views.filter_markets(_board(spark, sf, asset="ETH"), lens="received"))


@query
def board_kpis(spark, sf):
    return views.board_kpis(_board(spark, sf))


@query
def filtered_kpis(spark, sf):
    return views.board_kpis(_board(spark, sf, exchange="OKX"))


@query
def drilldown(spark, sf):
    """No market of that name is shown, so the first one shown is drilled into."""
    chosen = views.select_market(_board(spark, sf), wanted="no-such-market", exchange="Bybit", lens="received").first()
    # One name: the board of all markets is made once, and the market's days are compared without it.
    name = spark.createDataFrame([(chosen["market"],)] if chosen else [], "market string")
    return _series(spark, sf, name)


@query
def market_map(spark, sf):
    return views.market_map(_board(spark, sf))


def _markets(spark: SparkSession, sf: str) -> DataFrame:
    return mk.with_market_columns(snapshots(spark, sf).select("market").distinct())


@query
def option_lists(spark, sf):
    return views.option_lists(_markets(spark, sf))


@query
def default_asset(spark, sf):
    return views.default_asset(_markets(spark, sf))


@query
def cross_exchange(spark, sf):
    return cross.cross_exchange(_series(spark, sf))


@query
def cross_exchange_wide(spark, sf):
    exchanges = cross.exchanges_of(snapshots(spark, sf), "BTC")
    kept = views.kept_markets(snapshots(spark, sf), asset="BTC")
    return cross.cross_exchange_wide(cross.cross_exchange(_series(spark, sf, kept)), "BTC", exchanges)


# --- charts --------------------------------------------------------------------------------------------------


@query
def settlement_diff(spark, sf):
    return charts.settlement_diff(_series(spark, sf))


@query
def basis_domain(spark, sf):
    return charts.padded_domain(_series(spark, sf), [F.col("i") * 100, F.col("rf") * 100], ["market"])


def _basis_bps() -> Column:
    """Basis to a hundred-thousandth of a basis point: engines differ in the last bits, buckets have hard edges."""
    return F.round(F.col("fb") * 10000, 5)


@query
def basis_histogram(spark, sf):
    return charts.histogram(_series(spark, sf), _basis_bps())


@query
def market_histograms(spark, sf):
    return charts.histogram(_series(spark, sf), _basis_bps(), ["market"])


@query
def candles(spark, sf):
    return charts.candles(_candles(spark, sf))
