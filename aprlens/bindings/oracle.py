"""The registered queries as plain SQL over the same tables, written independently of the Spark jobs.

Interval averages are range joins here, percentiles ``quantile_cont``, modes a count and a row number.
"""

from __future__ import annotations

import re

from .adapters import AS_OF

CTES: dict[str, str] = {}
QUERIES: dict[str, str] = {}


def _venue(k: str) -> str:
    return (
        f"CASE {k} % 8 WHEN 0 THEN 'BINANCE' WHEN 1 THEN 'HYPERLIQUID' WHEN 2 THEN 'OKX' WHEN 3 THEN 'BYBIT' "
        "WHEN 4 THEN 'GATE' WHEN 5 THEN 'KUCOIN' WHEN 6 THEN 'LIGHTER' ELSE 'NOVA_dex2x' END"
    )


def _exchange(k: str) -> str:
    return (
        f"CASE {k} % 8 WHEN 0 THEN 'Binance' WHEN 1 THEN 'Hyperliquid' WHEN 2 THEN 'OKX' WHEN 3 THEN 'Bybit' "
        "WHEN 4 THEN 'Gate' WHEN 5 THEN 'KuCoin' WHEN 6 THEN 'Lighter' ELSE 'Nova_Dex2X' END"
    )


def _symbol(k: str) -> str:
    return (
        f"CASE CAST(floor({k} / 8) AS BIGINT) % 5 WHEN 0 THEN 'BTCUSDT' WHEN 1 THEN 'ETHUSDT' "
        "WHEN 2 THEN 'xyzGOLD' WHEN 3 THEN 'SP500' ELSE 'xyzadaUSDT' END"
    )


def _asset(symbol: str) -> str:
    return f"CASE {symbol} WHEN 'BTCUSDT' THEN 'BTC' WHEN 'ETHUSDT' THEN 'ETH' WHEN 'xyzGOLD' THEN 'XAU' WHEN 'SP500' THEN 'S&P500' ELSE 'ADA' END"


def _r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def _parts(market: str = "market") -> str:
    """The columns a market name encodes."""
    pattern = "^([0-9]+)-([^-]+)-(.+)-([0-9]{2}[A-Z]{3}[0-9]{4})$"

    def group(i: int) -> str:
        return f"regexp_extract({market}, '{pattern}', {i})"

    names = (
        f"CASE {group(2)} WHEN 'BINANCE' THEN 'Binance' WHEN 'HYPERLIQUID' THEN 'Hyperliquid' WHEN 'BYBIT' THEN 'Bybit' "
        f"WHEN 'GATE' THEN 'Gate' WHEN 'KUCOIN' THEN 'KuCoin' WHEN 'LIGHTER' THEN 'Lighter' WHEN 'NOVA_dex2x' THEN 'Nova_Dex2X' ELSE {group(2)} END"
    )
    return (
        f"{group(1)} AS market_id, {group(2)} AS venue, {names} AS exchange, {group(3)} AS symbol, "
        f"{_asset(group(3))} AS asset, CAST(strptime({group(4)}, '%d%b%Y') AS DATE) AS maturity"
    )


CTES["raw_lines"] = f"""
SELECT *, l_suppkey % 40 AS k, CAST(l_shipdate AS DATE) AS day,
  l_discount * (CAST(1000 AS DOUBLE) / 1009) AS d, l_tax * (CAST(1000 AS DOUBLE) / 1009) AS t,
  CAST(last_day(date_trunc('quarter', CAST(l_shipdate AS DATE) + to_months(CAST(3 * (l_linenumber % 2) AS INTEGER)))
    + INTERVAL 2 MONTH) AS DATE) AS mat
FROM lineitem"""
CTES["named_lines"] = f"""
SELECT *, concat(k, '-', {_venue('k')}, '-', {_symbol('k')}, '-', upper(strftime(mat, '%d%b%Y'))) AS market
FROM raw_lines"""
CTES["snapshots"] = """
SELECT market, CAST(epoch(l_shipdate) AS BIGINT) AS timestamp, day AS date, l_orderkey AS blockNumber,
  CASE WHEN l_linenumber <> 7 THEN d END AS midApr, d - 0.001 AS bestBid, d + 0.001 AS bestAsk,
  (d + t) / 2 AS ammImpliedApr, t AS markApr, l_extendedprice AS notionalOI, d AS lastTradedApr,
  t AS latestSettlementApr
FROM named_lines"""
CTES["funding"] = f"""
SELECT {_exchange('o_custkey % 40')} AS exchange, {_asset(_symbol('(o_custkey % 40)'))} AS asset,
  CAST(o_orderdate AS DATE) AS date, o_totalprice / 5000011 AS annualizedFundingRate
FROM orders"""
CTES["settlements"] = """
SELECT market, CAST(epoch(l_shipdate) AS BIGINT) AS timestamp, day AS date, l_orderkey AS blockNumber,
  t AS settlementApr, concat(l_orderkey, '-', l_linenumber) AS txHash
FROM named_lines WHERE l_returnflag = 'R'"""
CTES["candles_in"] = """
SELECT market, day AS date, round(avg(d), 6) AS open, round(max(d), 6) AS high, round(min(d), 6) AS low,
  round(sum(d * l_quantity) / sum(l_quantity), 6) AS close, sum(l_quantity) AS volume
FROM named_lines GROUP BY market, day"""

CTES["market_day"] = f"""
SELECT *, {_parts()} FROM (
  SELECT market, date, CAST(count(*) AS BIGINT) AS samples, avg(midApr) AS midApr, avg(markApr) AS markApr,
    avg(ammImpliedApr) AS ammImpliedApr, avg(latestSettlementApr) AS latestSettlementApr, avg(notionalOI) AS notionalOI
  FROM snapshots GROUP BY market, date)"""
CTES["funding_day"] = """
SELECT exchange, asset, date, CAST(count(*) AS BIGINT) AS samples, avg(annualizedFundingRate) AS realizedApr
FROM funding WHERE annualizedFundingRate IS NOT NULL GROUP BY exchange, asset, date"""
CTES["settlement_day"] = f"""
SELECT *, {_parts()} FROM (
  SELECT market, date, CAST(count(*) AS BIGINT) AS samples, avg(settlementApr) AS settlementApr
  FROM settlements GROUP BY market, date)"""
CTES["bounded"] = f"""
SELECT *, least(maturity, DATE '{AS_OF}') AS forwardEnd FROM market_day"""
CTES["ahead"] = """
SELECT b.market, b.date, avg(f.realizedApr) AS realizedForwardApr, CAST(count(f.realizedApr) AS BIGINT) AS forwardDaysUsed
FROM bounded b LEFT JOIN funding_day f
  ON f.exchange = b.exchange AND f.asset = b.asset AND f.date BETWEEN b.date AND b.forwardEnd
GROUP BY b.market, b.date"""
CTES["comparison"] = """
SELECT b.market, b.market_id, b.exchange, b.asset, b.symbol, b.maturity, b.date, b.samples,
  coalesce(b.midApr, b.markApr) AS impliedApr, b.markApr, b.ammImpliedApr, b.latestSettlementApr,
  s.settlementApr, f.realizedApr AS realizedDailyApr, a.realizedForwardApr, a.forwardDaysUsed,
  coalesce(b.midApr, b.markApr) - f.realizedApr AS dailyBasisApr,
  coalesce(b.midApr, b.markApr) - a.realizedForwardApr AS forwardBasisApr, s.samples AS settlementSamples
FROM bounded b
JOIN ahead a ON a.market = b.market AND a.date = b.date
LEFT JOIN funding_day f ON f.exchange = b.exchange AND f.asset = b.asset AND f.date = b.date
LEFT JOIN settlement_day s ON s.market = b.market AND s.date = b.date"""
CTES["series"] = """
SELECT market, market_id, exchange, asset, symbol, maturity, date AS d, impliedApr AS i, realizedDailyApr AS rd,
  realizedForwardApr AS rf, dailyBasisApr AS db, forwardBasisApr AS fb, settlementApr AS s, latestSettlementApr AS ls,
  samples AS n, forwardDaysUsed AS fd, settlementSamples AS ss
FROM comparison"""
CTES["candle_rows"] = """
SELECT market, date AS d, open AS o, high AS h, low AS l, close AS c, volume AS v FROM candles_in"""


def _corr(x: str, y: str) -> str:
    both = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
    return (
        f"CASE WHEN count(*) {both} >= 2 THEN covar_pop({x}, {y}) {both} / "
        f"nullif(stddev_pop({x}) {both} * stddev_pop({y}) {both}, 0) END"
    )


CTES["summary"] = f"""
SELECT market, any_value(exchange) AS exchange, any_value(asset) AS asset, any_value(symbol) AS symbol,
  any_value(maturity) AS maturity, CAST(count(*) AS BIGINT) AS rows, min(date) AS firstDate, max(date) AS lastDate,
  100 * avg(impliedApr) AS avgImpliedPct, 100 * avg(realizedForwardApr) AS avgRealizedForwardPct,
  10000 * avg(forwardBasisApr) AS avgBasisBps, 10000 * avg(abs(forwardBasisApr)) AS meanAbsBasisBps,
  100 * arg_max_null(impliedApr, date) AS lastImpliedPct, 100 * arg_max_null(realizedForwardApr, date) AS lastRealizedForwardPct,
  {_corr('impliedApr', 'realizedDailyApr')} AS corrDaily
FROM comparison WHERE realizedForwardApr IS NOT NULL GROUP BY market"""
CTES["heat"] = """
SELECT exchange, asset, avg(avgBasisBps) AS avgBasisBps, CAST(count(*) AS BIGINT) AS markets
FROM summary GROUP BY exchange, asset"""
CTES["modes"] = """
SELECT m.market, x.ss AS mode_ss FROM (SELECT DISTINCT market FROM series) m LEFT JOIN (
  SELECT market, ss, row_number() OVER (PARTITION BY market ORDER BY n DESC, ss) AS pick FROM (
    SELECT market, ss, count(*) AS n FROM series WHERE ss IS NOT NULL GROUP BY market, ss)) x
ON x.market = m.market AND x.pick = 1"""
CTES["volumes"] = """
SELECT market, arg_max_null(v, d) AS latestVolume, avg(v) AS avgVolume, coalesce(sum(v), 0) AS totalVolume
FROM candle_rows GROUP BY market"""
CTES["site"] = f"""
SELECT q.market, q.marketId, q.exchange, q.asset, q.symbol, q.maturity, q.firstDate, q.lastDate, q.rows,
  m.mode_ss AS settlementSamplesPerDay, q.maturity <= x.last AS matured,
  CAST(date_diff('day', x.last, q.maturity) AS BIGINT) AS daysToMaturity,
  q.* EXCLUDE (market, marketId, exchange, asset, symbol, maturity, firstDate, lastDate, rows),
  v.latestVolume, v.avgVolume, v.totalVolume
FROM (
  SELECT market, any_value(market_id) AS marketId, any_value(exchange) AS exchange, any_value(asset) AS asset,
    any_value(symbol) AS symbol, any_value(maturity) AS maturity, min(d) AS firstDate, max(d) AS lastDate,
    CAST(count(*) AS BIGINT) AS rows,
    arg_max_null(i, d) AS latestImplied, arg_max_null(rd, d) AS latestRealizedDaily,
    arg_max_null(rf, d) AS latestRealizedForward, arg_max_null(fb, d) AS latestForwardBasis,
    avg(i) AS avgImplied, avg(rf) AS avgRealizedForward, avg(fb) AS avgForwardBasis,
    quantile_cont(fb, 0.5) AS medianForwardBasis, quantile_cont(fb, 0.1) AS p10ForwardBasis,
    quantile_cont(fb, 0.9) AS p90ForwardBasis,
    CASE WHEN count(fb) > 1 THEN stddev_pop(fb) END AS basisVol, avg(abs(fb)) AS meanAbsForwardBasis,
    CAST(count(*) FILTER (fb > 0) AS DOUBLE) / nullif(count(fb), 0) AS positiveBasisShare,
    avg(db) AS avgDailyBasis, {_corr('i', 'rd')} AS corrImpliedRealizedDaily
  FROM series GROUP BY market) q
JOIN modes m ON m.market = q.market
LEFT JOIN volumes v ON v.market = q.market
CROSS JOIN (SELECT max(d) AS last FROM series) x"""
CTES["board"] = """
SELECT market, any_value(exchange) AS exchange, any_value(asset) AS asset, any_value(maturity) AS maturity,
  sum(fb) AS gapSum, avg(i) AS avgImplied, avg(rf) AS avgRealizedForward, avg(fb) AS avgForwardBasis
FROM series GROUP BY market"""
CTES["stitched"] = """
SELECT asset, exchange, d, maturity, avg(i) AS implied FROM (
  SELECT *, min(maturity) OVER (PARTITION BY asset, exchange, d) AS nearest FROM series WHERE i IS NOT NULL)
WHERE maturity = nearest GROUP BY asset, exchange, d, maturity"""


def _needed(sql: str) -> list[str]:
    """CTEs a query uses, each after those it uses itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in out and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                out.append(name)

    visit(sql)
    return out


def _add(name: str, sql: str) -> None:
    ctes = ", ".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in _needed(sql))
    QUERIES[name] = f"WITH {ctes} {sql.strip()}" if ctes else sql.strip()


# --- files
CTES["wanted"] = """
SELECT path, size FROM documents_manifest
WHERE path = 'src1' OR path LIKE 'src1/%' OR path LIKE 'src2/%' OR path LIKE 'src7/%'"""
CTES["documents_manifest"] = "SELECT concat(source, '/', doc_id) AS path, n_chars AS size, doc_id FROM documents"
CTES["landed"] = "SELECT path, size + doc_id % 3 AS size FROM documents_manifest WHERE doc_id % 3 < 2"
_add("select_files", "SELECT path, size FROM wanted")
_add(
    "pending_files",
    "SELECT path, size FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM landed l WHERE l.path = w.path AND l.size = w.size)",
)
_add(
    "transfer_summary",
    f"""SELECT CASE WHEN l.path IS NULL THEN 'pending' ELSE 'skipped' END AS status, CAST(count(*) AS BIGINT) AS files,
  {_r('sum(w.size) / 1048576.0')} AS megabytes
FROM wanted w LEFT JOIN landed l ON l.path = w.path AND l.size = w.size GROUP BY 1""",
)

# --- expressions
_add(
    "market_meta",
    f"""SELECT DISTINCT market, CAST(k AS VARCHAR) AS market_id, {_venue('k')} AS venue, {_exchange('k')} AS exchange,
  {_symbol('k')} AS symbol, {_asset(_symbol('k'))} AS asset, mat AS maturity FROM named_lines""",
)
_add(
    "underlying_key",
    f"""SELECT stem, split_part(stem, '-', 1) AS exchange,
  CASE upper(substr(stem, strpos(stem, '-') + 1)) WHEN 'BTCUSDT' THEN 'BTC' WHEN 'ETHUSDT' THEN 'ETH' WHEN 'SP500' THEN 'S&P500'
    ELSE upper(substr(stem, strpos(stem, '-') + 1)) END AS asset, CAST(count(*) AS BIGINT) AS files
FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN concat({_exchange('(o_custkey % 40)')}, '-', {_symbol('(o_custkey % 40)')})
    ELSE concat({_venue('(o_custkey % 40)')}, '-', lower({_symbol('(o_custkey % 40)')}), '-', substr(o_orderpriority, 1, 1)) END AS stem
  FROM orders) GROUP BY stem""",
)
_add(
    "numeric_coercion",
    f"""SELECT event_id,
  CASE event_id % 8 WHEN 1 THEN 'number' WHEN 2 THEN 'number' WHEN 6 THEN 'number' WHEN 4 THEN 'nan' WHEN 5 THEN 'inf' END AS kind,
  {_r('''CASE event_id % 8 WHEN 1 THEN CAST(h AS DOUBLE) WHEN 2 THEN CAST(concat('1', h) AS DOUBLE) WHEN 6 THEN h / 100.0 END''')} AS value
FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS h FROM events)""",
)
_add(
    "epoch_fields",
    """SELECT event_id, seconds, CAST(make_timestamp(seconds * 1000000) AS DATE) AS date, iso,
  CASE WHEN event_id % 3 = 0 THEN 'event_type' ELSE iso END AS datetime
FROM (SELECT event_id, seconds, strftime(make_timestamp(seconds * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso
  FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events))""",
)

# --- cleaning
_MARKET = "market, market_id, venue, exchange, symbol, asset, maturity"
_ISO = "strftime(date, '%Y-%m-%dT00:00:00+00:00')"
_DATED = f"CASE WHEN blockNumber % 2 = 0 THEN concat('block ', blockNumber) ELSE {_ISO} END"
_APRS = ", ".join(
    f"{_r(c)} AS {c}"
    for c in ("midApr", "bestBid", "bestAsk", "ammImpliedApr", "markApr", "notionalOI", "lastTradedApr", "latestSettlementApr")
)
_add(
    "clean_market_data",
    f"""SELECT market, {_parts()}, timestamp, {_DATED} AS datetime, date, blockNumber, {_APRS},
  concat('market-data/', market, '/', year(date), '.ndjson.zip') AS source_path FROM snapshots""",
)
_add(
    "clean_underlying",
    f"""SELECT exchange, asset, CAST(epoch(date) AS BIGINT) AS timestamp, {_ISO} AS datetime, date,
  {_r('annualizedFundingRate')} AS annualizedFundingRate,
  concat('underlying-apr/', exchange, '-', lower(asset), '.ndjson.zip') AS source_path FROM funding""",
)
_add(
    "clean_settlement",
    f"""SELECT market, {_parts()}, timestamp, {_DATED} AS datetime, date, blockNumber, {_r('settlementApr')} AS settlementApr,
  txHash, concat('settlement/', market, '/', year(date), '.ndjson.zip') AS source_path FROM settlements""",
)
_add(
    "clean_ohlcv",
    f"""SELECT market, {_parts()}, CAST(epoch(date) AS BIGINT) AS periodStartTimestamp, {_ISO} AS datetime, date,
  {_r('open')} AS open, {_r('high')} AS high, {_r('low')} AS low, {_r('close')} AS close, {_r('volume')} AS volume,
  concat('ohlcv/1d/', market, '/', year(date), '.ndjson.zip') AS source_path FROM candles_in""",
)
CTES["faulty"] = """
SELECT CASE WHEN blockNumber % 13 = 0 THEN 'market-data/7-OKX-BTCUSDT-31FEB2024/x.ndjson.zip'
    ELSE concat('market-data/', market, '/', year(date), '.ndjson.zip') END AS source_path,
  CASE WHEN blockNumber % 5 = 0 OR blockNumber % 11 = 0 THEN 'line is no JSON object'
    WHEN blockNumber % 7 = 0 THEN 'timestamp is missing or invalid'
    WHEN blockNumber % 13 = 0 THEN 'market name holds no valid maturity' END AS reject_reason
FROM snapshots"""
_add(
    "rejected_lines",
    """SELECT source_path, reject_reason, CAST(count(*) AS BIGINT) AS lines,
  CAST(count(*) FILTER (reject_reason LIKE 'line%') AS BIGINT) AS kept
FROM faulty WHERE reject_reason IS NOT NULL GROUP BY 1, 2""",
)
_add(
    "table_row_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, CAST(count(*) AS BIGINT) AS rows FROM {t}"
        for n, t in (("market_data", "snapshots"), ("underlying_apr", "funding"), ("settlement", "settlements"), ("ohlcv_1d", "candles_in"))
    ),
)

# --- daily tables and the comparison
_KEYS = "market, market_id, exchange, asset, symbol, maturity"
_DAILY = ", ".join(f"{_r(c)} AS {c}" for c in ("midApr", "markApr", "ammImpliedApr", "latestSettlementApr", "notionalOI"))
_add("market_daily", f"SELECT {_KEYS}, date, samples, {_DAILY} FROM market_day")
_add(
    "market_daily_events",
    f"""SELECT {_KEYS}, date, samples, {_DAILY} FROM (SELECT *, {_parts()} FROM (
  SELECT concat(k, '-', {_venue('k')}, '-', {_symbol('k')}, '-29MAR2024') AS market, CAST(ts AS DATE) AS date,
    CAST(count(*) AS BIGINT) AS samples, avg(v) FILTER (event_id % 11 <> 0 AND event_id % 13 <> 0) AS midApr,
    avg(v) FILTER (event_type = 'click') AS markApr, avg(v) AS ammImpliedApr, CAST(NULL AS DOUBLE) AS latestSettlementApr,
    avg(v * 2) AS notionalOI
  FROM (SELECT *, user_id % 40 AS k, value / 5003 AS v FROM events) GROUP BY 1, 2))""",
)
_add("underlying_daily", f"SELECT exchange, asset, date, samples, {_r('realizedApr')} AS realizedApr FROM funding_day")
_add("settlement_daily", f"SELECT {_KEYS}, date, samples, {_r('settlementApr')} AS settlementApr FROM settlement_day")
for _name in ("market_daily", "underlying_daily", "settlement_daily"):
    QUERIES[f"{_name}_merged"] = QUERIES[_name]
CTES["late"] = """
SELECT DISTINCT exchange, asset, date FROM funding
WHERE day(date) = 15 AND month(date) % 4 = 0 AND asset IN ('BTC', 'ETH')"""
_add(
    "stale_rows",
    """SELECT DISTINCT b.market, b.date FROM bounded b LEFT JOIN late l ON l.exchange = b.exchange AND l.asset = b.asset
  AND (l.date = b.date OR l.date BETWEEN b.date AND b.forwardEnd)
WHERE l.date IS NOT NULL OR b.samples > 2""",
)
_add(
    "forward_prefix",
    f"""SELECT exchange, asset, date, {_r('realizedApr')} AS realizedApr, {_r('sum(realizedApr) OVER w')} AS rateSum,
  CAST(count(realizedApr) OVER w AS BIGINT) AS rateDays
FROM funding_day WINDOW w AS (PARTITION BY exchange, asset ORDER BY date ROWS UNBOUNDED PRECEDING)""",
)
QUERIES["forward_prefix_by_month"] = QUERIES["forward_prefix"]
CTES["line_values"] = """
SELECT market, date, blockNumber, sum(CASE WHEN blockNumber % 10 <> 0 THEN midApr - markApr END) AS diff
FROM snapshots GROUP BY ALL"""
_add(
    "running_line_values",
    f"""SELECT market, date, blockNumber, {_r('diff')} AS diff, {_r('sum(diff) OVER w')} AS sum,
  CAST(sum(CASE WHEN diff IS NOT NULL THEN 1 END) OVER w AS BIGINT) AS values
FROM line_values WINDOW w AS (PARTITION BY market ORDER BY date, blockNumber ROWS UNBOUNDED PRECEDING)""",
)
_add(
    "forward_average",
    f"""SELECT b.market, b.date, b.forwardEnd, {_r('f.realizedApr')} AS realizedDailyApr,
  {_r('a.realizedForwardApr')} AS realizedForwardApr, a.forwardDaysUsed
FROM bounded b JOIN ahead a ON a.market = b.market AND a.date = b.date
LEFT JOIN funding_day f ON f.exchange = b.exchange AND f.asset = b.asset AND f.date = b.date""",
)
_add(
    "daily_realized",
    f"""SELECT m.market, m.date, m.exchange, m.asset, m.samples, {_r('f.realizedApr')} AS realizedDailyApr
FROM market_day m LEFT JOIN funding_day f ON f.exchange = m.exchange AND f.asset = m.asset AND f.date = m.date""",
)
_add(
    "daily_settlement",
    f"""SELECT m.market, m.date, m.samples, {_r('s.settlementApr')} AS settlementApr, s.samples AS settlementSamples
FROM market_day m LEFT JOIN settlement_day s ON s.market = m.market AND s.date = m.date""",
)
_RATES = ", ".join(
    f"{_r(c)} AS {c}"
    for c in (
        "impliedApr", "markApr", "ammImpliedApr", "latestSettlementApr", "settlementApr", "realizedDailyApr",
        "realizedForwardApr", "dailyBasisApr", "forwardBasisApr",
    )
)
_add("apr_comparison", f"SELECT {_KEYS}, date, samples, {_RATES}, forwardDaysUsed FROM comparison")
QUERIES["apr_comparison_refreshed"] = QUERIES["apr_comparison"]

# --- dashboard
_STATS = ", ".join(
    f"{_r(c)} AS {c}"
    for c in (
        "avgImpliedPct", "avgRealizedForwardPct", "avgBasisBps", "meanAbsBasisBps", "lastImpliedPct",
        "lastRealizedForwardPct", "corrDaily",
    )
)
_SUMMARY = f"SELECT market, exchange, asset, symbol, maturity, rows, firstDate, lastDate, {_STATS} FROM summary"
_add("market_summary", _SUMMARY)
_add("market_summary_top24", _SUMMARY + " ORDER BY abs(coalesce(summary.avgBasisBps, 0)) DESC, market LIMIT 24")
_add("market_list", f"SELECT market, rows, firstDate, lastDate, {_r('avgBasisBps')} AS avgBasisBps FROM summary")
_add("heatmap", f"SELECT exchange, asset, {_r('avgBasisBps')} AS avgBasisBps, markets FROM heat")
_add(
    "heat_intensity",
    f"""SELECT exchange, asset, markets, {_r('avgBasisBps')} AS avgBasisBps,
  {_r('least(0.82, coalesce(abs(avgBasisBps), 0) / (SELECT greatest(max(abs(avgBasisBps)), 1) FROM heat))')} AS intensity,
  coalesce(avgBasisBps, 0) >= 0 AS positive FROM heat""",
)
_add(
    "dashboard_bounds",
    f"""SELECT r.dateMin, r.dateMax, r.rowCount, r.marketCount, s.avgAbsBasisBps FROM (
  SELECT min(date) AS dateMin, max(date) AS dateMax, CAST(count(*) AS BIGINT) AS rowCount,
    CAST(count(DISTINCT market) AS BIGINT) AS marketCount FROM comparison WHERE realizedForwardApr IS NOT NULL) r
CROSS JOIN (SELECT {_r('avg(meanAbsBasisBps)')} AS avgAbsBasisBps FROM summary) s""",
)
_add(
    "market_series",
    f"""SELECT market, date, {_r('impliedApr * 100')} AS implied, {_r('realizedDailyApr * 100')} AS realizedDaily,
  {_r('realizedForwardApr * 100')} AS realizedForward, {_r('forwardBasisApr * 10000')} AS basisBps
FROM comparison WHERE realizedForwardApr IS NOT NULL""",
)

# --- site
_SITE_NUMBERS = [
    "latestImplied", "latestRealizedDaily", "latestRealizedForward", "latestForwardBasis", "avgImplied",
    "avgRealizedForward", "avgForwardBasis", "medianForwardBasis", "p10ForwardBasis", "p90ForwardBasis", "basisVol",
    "meanAbsForwardBasis", "positiveBasisShare", "avgDailyBasis", "corrImpliedRealizedDaily", "latestVolume",
    "avgVolume", "totalVolume",
]
_add(
    "site_summary",
    "SELECT market, marketId, exchange, asset, symbol, maturity, firstDate, lastDate, rows, settlementSamplesPerDay, matured, "
    "daysToMaturity, " + ", ".join(f"{_r(c)} AS {c}" for c in _SITE_NUMBERS) + " FROM site",
)
_add("site_bounds", "SELECT min(d) AS dateMin, max(d) AS dateMax FROM series")
_add(
    "daily_corr",
    f"SELECT market, CAST(count(*) AS BIGINT) AS rows, {_r(_corr('i', 'rd'))} AS corr FROM series GROUP BY market",
)
_add(
    "basis_percentiles",
    f"""SELECT market, {_r('quantile_cont(fb, 0.1)')} AS p10, {_r('quantile_cont(fb, 0.5)')} AS p50,
  {_r('quantile_cont(fb, 0.9)')} AS p90, {_r('CASE WHEN count(fb) > 1 THEN stddev_pop(fb) END')} AS basisVol
FROM series GROUP BY market""",
)
_add(
    "line_percentiles",
    f"""SELECT asset, {_r('quantile_cont(v, 0.1)')} AS p10, {_r('quantile_cont(v, 0.5)')} AS p50, {_r('quantile_cont(v, 0.9)')} AS p90,
  {_r('arg_min(v, (-n, v))')} AS mode
FROM (SELECT {_asset(_symbol('k'))} AS asset, l_extendedprice AS v,
  count(*) OVER (PARTITION BY {_asset(_symbol('k'))}, l_extendedprice) AS n FROM named_lines) GROUP BY asset""",
)
_add("settlement_mode", "SELECT market, mode_ss AS settlementSamplesPerDay FROM modes")
_add(
    "volume_stats",
    f"""SELECT market, {_r('latestVolume')} AS latestVolume, {_r('avgVolume')} AS avgVolume,
  {_r('totalVolume')} AS totalVolume FROM volumes""",
)
_DAYS = ", ".join(f"{_r(c)} AS {c}" for c in ("i", "rd", "rf", "db", "fb", "s", "ls"))
_add("compact_series", f"SELECT {_KEYS}, d, {_DAYS}, n, fd, ss FROM series")
_add(
    "settlement_samples",
    """SELECT m.market, m.date, m.samples, s.samples AS settlementSamples
FROM market_day m LEFT JOIN settlement_day s ON s.market = m.market AND s.date = m.date""",
)
_add("underlying_series", f"SELECT concat(exchange, '|', asset) AS pair, date AS d, {_r('realizedApr')} AS r FROM funding_day")
_add(
    "payload_flat",
    f"""SELECT s.market, CAST(count(*) OVER (PARTITION BY s.market) AS BIGINT) AS rows, c.candles,
  CAST(row_number() OVER (PARTITION BY s.market ORDER BY d) - 1 AS BIGINT) AS pos, d, {_DAYS}, n, fd, ss
FROM series s LEFT JOIN (SELECT market, CAST(count(*) AS BIGINT) AS candles FROM candle_rows GROUP BY market) c
  ON c.market = s.market""",
)
_OHLCV = ", ".join(f"{_r(c)} AS {c}" for c in "ohlcv")
_add(
    "payload_candles",
    f"""SELECT market, CAST(row_number() OVER (PARTITION BY market ORDER BY d) - 1 AS BIGINT) AS pos, d, {_OHLCV}
FROM candle_rows""",
)

# --- views
_BOARD = (
    "market, exchange, asset, maturity, "
    + ", ".join(f"{_r(c)} AS {c}" for c in ("gapSum", "avgImplied", "avgRealizedForward", "avgForwardBasis"))
)
_add("gap_sum", f"SELECT {_BOARD} FROM board")
QUERIES["gap_board_merged"] = QUERIES["gap_sum"]
_add(
    "gap_label",
    f"""SELECT market, {_r('avgForwardBasis')} AS avgForwardBasis,
  CASE WHEN avgForwardBasis IS NULL THEN 'Insufficient data' WHEN abs(avgForwardBasis) < 0.0005 THEN 'Near realized'
    WHEN avgForwardBasis > 0 THEN 'Paid more than realized' ELSE 'Received more than paid' END AS gapLabel,
  CASE WHEN avgForwardBasis IS NULL OR abs(avgForwardBasis) < 0.0005 THEN 'neutral'
    WHEN avgForwardBasis > 0 THEN 'positive-gap' ELSE 'negative-gap' END AS gapClass FROM board""",
)
_add(
    "gap_rank",
    f"SELECT market, exchange, asset, maturity, {_r('gapSum')} AS gapSum, {_r('abs(coalesce(gapSum, 0))')} AS gapSize FROM board",
)
_add(
    "largest_gap",
    f"""SELECT market, exchange, asset, maturity, {_r('gapSum')} AS gapSum FROM board
ORDER BY abs(coalesce(board.gapSum, 0)) DESC, market LIMIT 1""",
)
_add("filtered_markets", f"SELECT {_BOARD} FROM board WHERE exchange = 'Binance' AND asset = 'BTC'")
_add("filtered_maturity", f"SELECT {_BOARD} FROM board WHERE maturity = DATE '1998-03-31'")
_add("lens_paid", f"SELECT {_BOARD} FROM board WHERE gapSum > 0")
_add("lens_received", f"SELECT {_BOARD} FROM board WHERE asset = 'ETH' AND gapSum < 0")
_KPIS = f"""SELECT CAST(count(*) AS BIGINT) AS markets, {_r('avg(abs(coalesce(gapSum, 0)))')} AS avgAbsGapSum,
  CAST(count(*) FILTER (gapSum > 0) AS BIGINT) AS paidMore, CAST(count(*) FILTER (gapSum < 0) AS BIGINT) AS receivedMore
FROM board"""
_add("board_kpis", _KPIS)
_add("filtered_kpis", _KPIS + " WHERE exchange = 'OKX'")
_add(
    "drilldown",
    f"""SELECT {_KEYS}, d, {_DAYS}, n, fd, ss FROM series WHERE market = (
  SELECT market FROM board ORDER BY CASE WHEN exchange = 'Bybit' AND gapSum < 0 THEN 1 ELSE 2 END,
    CASE WHEN exchange = 'Bybit' AND gapSum < 0 THEN abs(gapSum) END DESC NULLS LAST, market LIMIT 1)""",
)
_add(
    "market_map",
    f"""SELECT market, exchange, asset, maturity, {_r('avgImplied')} AS avgImplied, {_r('avgRealizedForward')} AS avgRealizedForward,
  {_r('avgForwardBasis')} AS avgForwardBasis, avgImplied > avgRealizedForward AS aboveDiagonal
FROM board WHERE avgImplied IS NOT NULL AND avgRealizedForward IS NOT NULL""",
)
_add(
    "option_lists",
    f"""SELECT DISTINCT 'exchange' AS kind, {_exchange('k')} AS value FROM raw_lines
UNION ALL SELECT DISTINCT 'asset', {_asset(_symbol('k'))} FROM raw_lines
UNION ALL SELECT DISTINCT 'maturity', CAST(mat AS VARCHAR) FROM raw_lines""",
)
_add(
    "default_asset",
    f"""SELECT CASE WHEN count(*) FILTER (asset = 'BTC') > 0 THEN 'BTC' ELSE min(asset) END AS asset
FROM (SELECT {_asset(_symbol('k'))} AS asset FROM raw_lines)""",
)
_add("cross_exchange", f"SELECT asset, exchange, d, maturity, {_r('implied')} AS implied FROM stitched")
# The exchanges that markets of this symbol can name; all of them do from sf0.01 on.
_VENUES_SHOWN = ["Binance", "Hyperliquid", "OKX", "Bybit", "Gate", "KuCoin", "Lighter", "Nova_Dex2X"]
_COLUMNS = ", ".join(f"""max(CASE WHEN exchange = '{name}' THEN {_r('implied')} END) AS "{name}\"""" for name in _VENUES_SHOWN)
_add("cross_exchange_wide", f"SELECT d, {_COLUMNS} FROM stitched WHERE asset = 'BTC' GROUP BY d")

# --- charts
CTES["periods"] = """
SELECT s.market, s.d, s.i, s.s, s.ss, coalesce(nullif(m.mode_ss, 0), nullif(s.ss, 0)) AS settlementsPerDay,
  coalesce(nullif(s.ss, 0), nullif(m.mode_ss, 0)) AS settlementPeriods
FROM series s JOIN modes m ON m.market = s.market"""
CTES["diffs"] = """
SELECT *, i * 10000 / (365 * settlementsPerDay) AS impliedFundingBps, s * 10000 / (365 * settlementsPerDay) AS settlementFundingBps,
  (i * 10000 / (365 * settlementsPerDay) - s * 10000 / (365 * settlementsPerDay)) * settlementPeriods AS diff
FROM periods"""
_add(
    "settlement_diff",
    f"""SELECT market, d, {_r('i')} AS i, {_r('s')} AS s, ss, settlementsPerDay, settlementPeriods,
  {_r('impliedFundingBps')} AS impliedFundingBps, {_r('settlementFundingBps')} AS settlementFundingBps,
  {_r('CASE WHEN diff IS NOT NULL THEN sum(diff) OVER (PARTITION BY market ORDER BY d ROWS UNBOUNDED PRECEDING) END')}
    AS cumulativeSettlementDiffBps
FROM diffs""",
)


def _domain(source: str, low: str, high: str, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""
SELECT {lead}CASE WHEN low IS NULL THEN 0.0 WHEN low = high THEN low - 1 - 0.16 ELSE low - 0.08 * (high - low) END AS lo,
  CASE WHEN low IS NULL THEN 1.0 WHEN low = high THEN high + 1 + 0.16 ELSE high + 0.08 * (high - low) END AS hi
FROM (SELECT {lead}{low} AS low, {high} AS high FROM {source}{group})"""


CTES["market_domain"] = _domain("series", "least(min(i), min(rf)) * 100", "greatest(max(i), max(rf)) * 100", "market")
CTES["basis_bps"] = "SELECT market, round(fb * 10000, 5) AS v FROM series WHERE fb IS NOT NULL"
CTES["basis_range"] = _domain("basis_bps", "min(v)", "max(v)")
CTES["market_basis_range"] = f"""
SELECT m.market, coalesce(r.lo, 0.0) AS lo, coalesce(r.hi, 1.0) AS hi FROM (SELECT DISTINCT market FROM series) m
LEFT JOIN ({_domain("basis_bps", "min(v)", "max(v)", "market").strip()}) r ON r.market = m.market"""
_add("basis_domain", f"SELECT market, {_r('lo')} AS lo, {_r('hi')} AS hi FROM market_domain")
_HISTOGRAM = f"""bucket, {_r('lo + bucket * (hi - lo) / 18')} AS lo, {_r('lo + (bucket + 1) * (hi - lo) / 18')} AS hi, days,
  lo + (bucket + 0.5) * (hi - lo) / 18 >= 0 AS positive"""
_BUCKET = "greatest(0, least(17, CAST(floor((v - lo) / (hi - lo) * 18) AS BIGINT)))"
_add(
    "basis_histogram",
    f"""SELECT {_HISTOGRAM} FROM (
  SELECT g.bucket, r.lo, r.hi, CAST(count(p.b) AS BIGINT) AS days FROM (SELECT range AS bucket FROM range(18)) g
  CROSS JOIN basis_range r
  LEFT JOIN (SELECT {_BUCKET} AS b FROM basis_bps CROSS JOIN basis_range) p ON p.b = g.bucket
  GROUP BY g.bucket, r.lo, r.hi)""",
)
_add(
    "market_histograms",
    f"""SELECT market, {_HISTOGRAM} FROM (
  SELECT r.market, g.bucket, r.lo, r.hi, CAST(count(p.b) AS BIGINT) AS days FROM (SELECT range AS bucket FROM range(18)) g
  CROSS JOIN market_basis_range r
  LEFT JOIN (SELECT s.market, {_BUCKET} AS b FROM basis_bps s JOIN market_basis_range x ON x.market = s.market) p ON p.b = g.bucket AND p.market = r.market
  GROUP BY r.market, g.bucket, r.lo, r.hi)""",
)
_add(
    "candles",
    f"""SELECT market, d, {_OHLCV}, CASE WHEN o IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL THEN c >= o END AS up,
  {_r('v / greatest(max(v) OVER (PARTITION BY market), 1)')} AS volumeShare FROM candle_rows""",
)
_add(
    "candle_days",
    f"""SELECT market, d, {_OHLCV}, "at" FROM (
  SELECT market, d, first(o ORDER BY "at") AS o, max(h) AS h, min(l) AS l, last(c ORDER BY "at") AS c, sum(v) AS v, min("at") AS "at"
  FROM (SELECT market, date AS d, midApr AS o, bestAsk AS h, bestBid AS l, markApr AS c, notionalOI AS v, blockNumber AS "at"
    FROM snapshots QUALIFY row_number() OVER (PARTITION BY market, date, blockNumber
      ORDER BY v DESC NULLS LAST, c DESC NULLS LAST, h DESC NULLS LAST, l DESC NULLS LAST, o DESC NULLS LAST) = 1)
  GROUP BY market, d)""",
)
