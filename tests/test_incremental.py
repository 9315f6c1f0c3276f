"""Updates against whole runs: merged days, invalidated windows, ledgers, replays and what is not read."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from aprlens.operators import compare, daily, forward, views
from aprlens.plans import incremental, pipeline
from aprlens.sources import tables
from aprlens.streaming import ingest
from tests.conftest import rows_of, write_archive

AS_OF = "2025-12-31"
MARKETS = ["1-OKX-BTCUSDT-28MAR2025", "2-OKX-ETHUSDT-27JUN2025", "3-BYBIT-BTCUSDT-26SEP2025"]


def second(day: dt.date, hour: int = 0) -> int:
    return int(dt.datetime(day.year, day.month, day.day, hour, tzinfo=dt.UTC).timestamp())


def land(root: Path, batch: str, days: list[dt.date], seed: int, faults: bool = False) -> None:
    rng = random.Random(seed)
    for market in MARKETS:
        snaps = [{"timestamp": second(d, h), "midApr": rng.random(), "markApr": rng.random()} for d in days for h in (1, 2)]
        write_archive(root / "market-data" / market / f"{batch}.ndjson.zip", {"m": [*snaps, *(["no json", {"midApr": 1}] if faults else [])]})
        write_archive(
            root / "settlement" / market / f"{batch}.ndjson.zip",
            {"m": [{"timestamp": second(d), "settlementApr": rng.random()} for d in days[::2]]},
        )
    for stem in ("OKX-btcusdt", "OKX-ethusdt", "BYBIT-btcusdt"):
        rates = [{"timestamp": second(d, h), "annualizedFundingRate": rng.random()} for d in days for h in (0, 8)]
        write_archive(root / "underlying-apr" / batch / f"{stem}.ndjson.zip", {"m": rates})


def days_of(month: int, count: int = 12) -> list[dt.date]:
    return [dt.date(2025, month, 1 + 2 * k) for k in range(count)]


def rounded(df):
    cells = [F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    return sorted(map(str, df.select(*cells).collect()))


def whole_run(spark, raw, out):
    pipeline.clean_tables(spark, raw, out)
    pipeline.daily_tables(spark, out, AS_OF)
    return {n: spark.read.parquet(f"{out}/{n}") for n in ("market_daily_apr", "underlying_daily_apr", "settlement_daily_apr", "apr_comparison_daily")}


def test_updates_equal_a_whole_run(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "kept")
    land(raw, "a", days_of(1), 1, faults=True)
    land(raw, "b", days_of(3), 2)
    counts, months = incremental.update(spark, str(raw), out, AS_OF)
    assert counts["market_data"] == (3 * 48, 6)
    assert months["apr_comparison_daily"] == [dt.date(2025, 1, 1), dt.date(2025, 3, 1)]
    land(raw, "c", [dt.date(2025, 3, 30), *days_of(4)], 3)
    assert incremental.update(spark, str(raw), out, AS_OF)[1]["market_daily_apr"] == [dt.date(2025, 3, 1), dt.date(2025, 4, 1)]
    late = [{"timestamp": second(dt.date(2025, 3, 5), 4), "annualizedFundingRate": 0.9}]
    write_archive(raw / "underlying-apr" / "d" / "OKX-ethusdt.ndjson.zip", {"m": late})
    months = incremental.update(spark, str(raw), out, AS_OF)[1]
    assert months == {
        "market_daily_apr": [], "underlying_daily_apr": [dt.date(2025, 3, 1)], "settlement_daily_apr": [],
        "apr_comparison_daily": [dt.date(2025, 1, 1), dt.date(2025, 3, 1)],
    }
    stale = set(rows_of(spark.read.parquet(f"{out}/stale_rows"), "market", "date"))
    assert stale == {(MARKETS[1], d) for d in [*days_of(1), *days_of(3)] if d <= dt.date(2025, 3, 5)}
    for name, expected in whole_run(spark, str(raw), str(tmp_path / "whole")).items():
        found = tables.read_months(spark, f"{out}/{name}")
        assert rounded(found.select(*expected.columns)) == rounded(expected), name
    series = expected.select("market", F.col("forwardBasisApr").alias("fb"), F.col("impliedApr").alias("i"), F.col("realizedForwardApr").alias("rf"))
    board = incremental.gap_board(spark, out)
    assert name == "apr_comparison_daily" and rounded(board) == rounded(views.market_board(series))
    drilled = incremental.drilldown(spark, out, wanted="none", exchange="Bybit")
    assert {r["market"] for r in drilled.collect()} == {MARKETS[2]}
    plan = drilled._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(market), EqualTo(market" in plan and "Join" not in plan
    assert incremental.update(spark, str(raw), out, AS_OF)[1]["apr_comparison_daily"] == []
    reasons = rows_of(incremental.all_rejected(spark, out).groupBy("name", "reject_reason").count())
    assert sorted(reasons) == [("market_data", "line is no JSON object", 3), ("market_data", "timestamp is missing or invalid", 3)]


def test_other_rows_and_months_are_left_alone(spark, tmp_path):
    """A row outside the stale windows keeps a value planted in it; partials of untouched months are not even opened."""
    raw, out = tmp_path / "raw", str(tmp_path / "kept")
    land(raw, "a", [*days_of(1), *days_of(2)], 1)
    incremental.update(spark, str(raw), out, AS_OF)
    planted = tables.read_months(spark, f"{out}/apr_comparison_daily").withColumn("markApr", F.lit(7.0)).cache()
    planted.count()
    tables.write_months(planted, f"{out}/apr_comparison_daily", ["market", "date"])
    for part in Path(f"{out}/market_data_partials/month=2025-01-01").rglob("*.parquet"):
        part.write_bytes(b"not read")
        (part.parent / f".{part.name}.crc").unlink()
    write_archive(raw / "underlying-apr" / "d" / "OKX-btcusdt.ndjson.zip", {"m": [{"timestamp": second(dt.date(2025, 2, 10)), "annualizedFundingRate": 0.5}]})
    write_archive(raw / "market-data" / MARKETS[2] / "d.ndjson.zip", {"m": [{"timestamp": second(dt.date(2025, 2, 20)), "markApr": 0.5}]})
    incremental.update(spark, str(raw), out, AS_OF)
    rows = rows_of(tables.read_months(spark, f"{out}/apr_comparison_daily"), "market", "date", "markApr")
    again = {(m, d) for m, d, mark in rows if mark != 7.0}
    expected = {(MARKETS[0], d) for d in [*days_of(1), *days_of(2)] if d <= dt.date(2025, 2, 10)} | {(MARKETS[2], dt.date(2025, 2, 20))}
    assert again == expected and len(rows) == 3 * 24 + 1
    plan = incremental.days_of_months(spark, out, "market_data", [dt.date(2025, 2, 1)])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan.replace("`", "") or "month" in plan.split("PartitionFilters")[1][:80]


def test_moving_reference_day(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "kept")
    land(raw, "a", [*days_of(1), *days_of(2)], 1)
    for as_of in ("2025-01-20", "2025-02-09", "2025-01-31", AS_OF):
        incremental.update(spark, str(raw), out, as_of)
        days = [tables.read_months(spark, f"{out}/{n}_daily_apr") for n in ("market", "underlying", "settlement")]
        expected = compare.apr_comparison(*days, as_of=as_of)
        assert rounded(tables.read_months(spark, f"{out}/apr_comparison_daily").select(*expected.columns)) == rounded(expected)


def test_a_replayed_batch_counts_once(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "kept")
    land(raw, "a", days_of(1), 1, faults=True)
    counts = incremental.ingest_new(spark, str(raw), out)["market_data"]
    dataset, table = pipeline.CLEAN_TABLES["market_data"], f"{out}/market_data"
    (batch,) = ingest.batches_of(spark, table)
    from aprlens.operators.clean import read_lines

    lines = read_lines(spark, str(raw), dataset)
    for _ in range(2):
        ingest.write_batch(lines, dataset, table, batch)
        incremental.add_partials(spark, out, "market_data", batch)
    assert ingest.accepted_lines(spark, dataset, table).count() == counts.accepted
    assert ingest.rejected_lines(spark, table).count() == counts.rejected
    assert lines.count() == sum(counts)
    parts = tables.read_months(spark, f"{out}/market_data_partials")
    assert parts.agg(F.sum("samples")).first()[0] == counts.accepted
    # A batch that never reached the ledger is not read.
    ingest.accepted_lines(spark, dataset, table).limit(3).coalesce(1).write.parquet(f"{table}/batch=99")
    assert ingest.accepted_lines(spark, dataset, table).count() == counts.accepted


@pytest.mark.parametrize("kind", ["MARKET_DAYS", "UNDERLYING_DAYS", "SETTLEMENT_DAYS"])
def test_partials_of_parts_equal_one_pass(spark, kind):
    table = getattr(daily, kind)
    rng = random.Random(4)
    value = lambda: rng.choice([None, float("nan"), float("inf"), *[rng.random()] * 5])
    columns = list(table.means)
    rows = [
        (*[rng.choice("ab") for _ in table.keys], dt.date(2025, 1, rng.randint(1, 5)), *[value() for _ in columns]) for _ in range(300)
    ]
    schema = ", ".join([*[f"{k} string" for k in table.keys], "date date", *[f"{c} double" for c in columns]])
    df = spark.createDataFrame(rows, schema)
    halves = [daily.partials(spark.createDataFrame(rows[k::3], schema), table) for k in range(3)]
    parts = daily.added(halves[0].unionByName(halves[1]), table).unionByName(halves[2].select(*table.days, *table.sums))
    one_pass = {"MARKET_DAYS": daily.market_daily, "UNDERLYING_DAYS": daily.underlying_daily, "SETTLEMENT_DAYS": daily.settlement_daily}[kind]
    assert rounded(daily.merged(parts, table)) == rounded(one_pass(df))


def test_touched_rows_equal_brute_force(spark):
    rng = random.Random(6)
    start = dt.date(2024, 12, 20)
    day = lambda: start + dt.timedelta(rng.randint(0, 120))
    rows = [(i, rng.choice(["OKX", "Gate"]), rng.choice(["BTC", "ETH"]), day(), rng.choice([None, day(), day()])) for i in range(300)]
    changed = [(rng.choice(["OKX", "Gate"]), "BTC", day()) for _ in range(5)]
    end = dt.date(2025, 3, 20)
    expected = sorted(
        i for i, ex, asset, at, until in rows
        if any((ex, asset) == (e, a) and (at == d or until is not None and at <= d <= min(until, end)) for e, a, d in changed)
    )
    df = spark.createDataFrame(rows, "id int, exchange string, asset string, date date, maturity date")
    late = spark.createDataFrame(changed * 2, "exchange string, asset string, date date")
    assert sorted(r["id"] for r in forward.touched_by(df, late, end).collect()) == expected


def test_months_are_replaced_alone_and_files_hold_ranges(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(f"m{k % 7}", dt.date(2025, 1 + k % 3, 1 + k % 28), float(k)) for k in range(300)], "market string, date date, x double")
    tables.write_months(df, path, ["market", "date"])
    tables.write_months(df.where("month(date) = 2").withColumn("x", F.lit(-1.0)), path, ["market", "date"])
    back = tables.read_months(spark, path)
    assert back.count() == 300 and back.where("x = -1").count() == back.where("month(date) = 2").count() > 0
    one = tables.read_months(spark, path, [dt.date(2025, 2, 1)])
    assert one.count() == back.where("x = -1").count()
    files = spark.read.parquet(path).withColumn("file", F.input_file_name()).groupBy("month", "file").agg(F.min("market").alias("low"), F.max("market").alias("high"))
    by_month = {}
    for r in files.collect():
        by_month.setdefault(r["month"], []).append((r["low"], r["high"]))
    for ranges in by_month.values():
        assert all(a[1] <= b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:], strict=False))


def test_bucketed_days_join_and_group_without_a_shuffle(spark, tmp_path):
    df = spark.createDataFrame([(f"m{k % 9}", dt.date(2025, 1, 1 + k % 28), float(k)) for k in range(200)], "market string, date date, x double")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("left_days", "right_days"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            tables.write_bucketed(df, name, str(tmp_path / name), 4, ["market"], ["date"])
        left, right = spark.table("left_days"), spark.table("right_days").withColumnRenamed("x", "y")
        joined = left.join(right, ["market", "date"]).groupBy("market").agg(F.sum("x"), F.count("y"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.count() == 9
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("left_days", "right_days"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
