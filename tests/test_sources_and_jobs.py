"""Archives, tables, the manifest and the whole job, on files written for the test."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from aprlens.operators import clean
from aprlens.plans import pipeline
from aprlens.sources import archives, manifest, tables
from aprlens.streaming import ingest
from tests.conftest import rows_of, write_archive

MARKET = "5-OKX-BTCUSDT-31JAN2025"
DAY1, DAY2 = 1735689600, 1735776000


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "market-data" / "raw"
    snap = root / "market-data" / MARKET
    write_archive(
        snap / "a.ndjson.zip",
        {
            "inner/": [],
            "one.ndjson": [
                {"timestamp": DAY1, "midApr": 0.1, "datetime": "", "blockNumber": 7},
                "   ",
                {"timestamp": DAY1 + 60, "midApr": "0.3", "markApr": "1_000"},
                '{"timestamp": 1735689660, "midApr": NaN, "markApr": "1.5d"}\r',
            ],
            "two.ndjson": [{"timestamp": str(DAY2), "midApr": None, "markApr": 0.2, "datetime": "given"}, ""],
        },
    )
    write_archive(snap / "deep" / MARKET / "b.ndjson.zip", {"x": ["not json", {"midApr": 1}, "[1]", {"timestamp": 1e15}]})
    write_archive(root / "market-data" / "9-OKX-BTCUSDT-31FEB2025" / "c.ndjson.zip", {"x": [{"timestamp": DAY1}]})
    write_archive(root / "market-data" / "odd" / "d.ndjson.zip", {"x": [{"timestamp": DAY1, "markApr": 0.5}]})
    (snap / "notes.txt").write_text("no archive")
    write_archive(
        root / "underlying-apr" / "2025" / "OKX-btcusdt.ndjson.zip",
        {"x": [{"timestamp": DAY1, "annualizedFundingRate": 0.05}, {"timestamp": DAY2, "annualizedFundingRate": 0.07}]},
    )
    write_archive(root / "underlying-apr" / "nodash.ndjson.zip", {"x": [{"timestamp": DAY1}]})
    write_archive(root / "settlement" / MARKET / "s.ndjson.zip", {"x": [{"timestamp": DAY1, "settlementApr": 0.06, "txHash": "0x1"}]})
    write_archive(
        root / "ohlcv" / "1d" / MARKET / "o.ndjson.zip",
        {"x": [{"periodStartTimestamp": DAY1, "open": 0.1, "high": 0.2, "low": 0.1, "close": 0.2, "volume": 12}]},
    )
    return str(root)


def test_market_data_lines(spark, raw, day):
    lines = clean.read_lines(spark, raw, clean.MARKET_DATA).cache()
    good = clean.clean_market_data(lines)
    assert good.columns == list(clean.MARKET_DATA.columns)
    rows = sorted(rows_of(good.where(F.col("market") == MARKET), "timestamp", "midApr", "markApr", "datetime"), key=str)
    assert rows[0] == (DAY1, 0.1, None, "2025-01-01T00:00:00+00:00")
    assert rows[1] == (DAY1 + 60, 0.3, 1000.0, "2025-01-01T00:01:00+00:00")
    assert rows[2][0] == DAY1 + 60 and rows[2][1] != rows[2][1] and rows[2][2] is None
    assert rows[3] == (DAY2, None, 0.2, "given")
    odd = good.where(F.col("market") == "odd").collect()[0]
    assert odd.exchange is None and odd.source_path == "market-data/odd/d.ndjson.zip" and odd.date == day("2025-01-01")
    first = good.where(F.col("blockNumber") == 7).collect()[0]
    assert first.source_path == f"market-data/{MARKET}/a.ndjson.zip" and first.maturity == day("2025-01-31")
    reasons = sorted(rows_of(clean.rejected(lines, clean.MARKET_DATA), "reject_reason", "line"), key=str)
    assert reasons == [
        ("line is no JSON object", "[1]"),
        ("line is no JSON object", "not json"),
        ("market name holds no valid maturity", None),
        ("timestamp is missing or invalid", None),
        ("timestamp is missing or invalid", None),
    ]
    with pytest.raises(Exception, match="line is no JSON object|maturity|timestamp"):
        clean.clean_market_data(lines, strict=True).collect()


def test_odd_paths_and_nested_prefixes(spark, tmp_path):
    """Blanks, %, # in a path, and a folder that repeats the prefix and the root's name."""
    root = tmp_path / "my raw"
    name = "market-data/a b%20#c/market-data/my raw/x.ndjson.zip"
    write_archive(root / name, {"m": [{"timestamp": DAY1}]})
    for given in (str(root), f"{root}/"):
        assert rows_of(archives.scan_archives(spark, given, "market-data"), "source_path") == [(name,)]
        assert rows_of(manifest.landed_files(spark, given), "path") == [(name,)]


def test_unreadable_archive_is_one_reject(spark, tmp_path):
    folder = tmp_path / "settlement" / MARKET
    write_archive(folder / "good.ndjson.zip", {"m": [{"timestamp": DAY1}]})
    (folder / "bad.ndjson.zip").write_bytes(b"PK no archive")
    lines = clean.read_lines(spark, str(tmp_path), clean.SETTLEMENT)
    assert clean.clean_settlement(lines).count() == 1
    (row,) = clean.rejected(lines, clean.SETTLEMENT).collect()
    assert row.source_path.endswith("bad.ndjson.zip") and row.reject_reason.startswith("archive is unreadable")
    with pytest.raises(Exception, match="unreadable"):
        clean.clean_settlement(lines, strict=True).collect()


def test_rejects_are_counted_and_kept(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    counts = pipeline.clean_tables(spark, raw, out)
    for name, dataset in pipeline.CLEAN_TABLES.items():
        lines = clean.read_lines(spark, raw, dataset).count()
        assert sum(counts[name]) == lines and tables.read_table(spark, f"{out}/{name}").count() == counts[name].accepted
        if counts[name].rejected:
            assert tables.read_table(spark, f"{out}/{name}_rejected").count() == counts[name].rejected


def test_csv_jobs_equal_parquet_jobs(spark, raw, tmp_path):
    found = {}
    for fmt in ("parquet", "csv"):
        out = str(tmp_path / fmt)
        pipeline.clean_tables(spark, raw, out, fmt=fmt)
        pipeline.daily_tables(spark, out, "2025-06-30", fmt)
        pipeline.site_tables(spark, out, fmt)
        read = [tables.read_table(spark, f"{out}/{t}") for t in ("market_daily_apr", "apr_comparison_daily", "site_summary", "site_candles")]
        found[fmt] = [(t.schema, sorted(map(str, t.collect()))) for t in read]
    assert found["csv"] == found["parquet"]


def test_blocks_end_with_whole_lines(spark, tmp_path, monkeypatch):
    lines = [f'{{"n": {i}, "pad": "é{"x" * (i % 50)}"}}' for i in range(500)]
    write_archive(tmp_path / "a.ndjson.zip", {"m": lines})
    monkeypatch.setattr(archives, "BLOCK_BYTES", 100)
    with open(tmp_path / "a.ndjson.zip", "rb") as handle:
        blocks = list(archives._member_blocks(handle))
    assert len(blocks) > 50 and b"".join(blocks).decode().split("\n") == lines
    assert all(b.endswith(b"\n") for b in blocks[:-1])


def test_absent_directory_is_empty(spark, tmp_path):
    assert clean.clean_settlement(clean.read_lines(spark, str(tmp_path), clean.SETTLEMENT)).count() == 0


def test_csv_and_parquet_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.5), ("b,c", "", None)], "k string, t string, x double")
    tables.write_table(df, str(tmp_path / "c"), ["x", "k"], "csv")
    back = tables.read_table(spark, str(tmp_path / "c"), "csv")
    assert back.columns == ["x", "k"] and sorted(rows_of(back), key=str) == [("1.5", "a"), (None, "b,c")]
    named = tables.read_table(spark, str(tmp_path / "c"), "csv", ["x", "k"])
    assert sorted(rows_of(named), key=str) == [("1.5", "a"), (None, "b,c")]
    tables.write_table(df, str(tmp_path / "p"))
    assert tables.read_table(spark, str(tmp_path / "p")).schema == df.schema


def test_manifest(spark, raw, tmp_path):
    landed = {r.path: r.size for r in manifest.landed_files(spark, raw).collect()}
    done = "settlement/%s/s.ndjson.zip" % MARKET
    files = [
        {"path": done, "size": landed[done]},
        {"path": "settlement/%s/t.ndjson.zip" % MARKET, "size": 1024 * 1024},
        {"path": "ohlcv/1d/%s/o.ndjson.zip" % MARKET, "size": 1},
        {"path": "ohlcv/1h/x.ndjson.zip", "size": 1},
        {"path": "market-trades/x", "size": 1},
        {"path": "settlements/x", "size": 1},
    ]
    path = tmp_path / "files.json"
    path.write_text(json.dumps(files, indent=2))
    pending, summary = pipeline.transfer_plan(spark, str(path), raw)
    assert sorted(r.path for r in pending.collect()) == sorted([files[1]["path"], files[2]["path"]])
    got = {r.status: (r.files, r.megabytes) for r in summary.collect()}
    assert got["skipped"][0] == 1 and got["pending"] == (2, pytest.approx(1 + 1 / 1048576))
    chosen = manifest.select_files(manifest.read_manifest(spark, str(path)), ["ohlcv/"], trades=True)
    assert sorted(r.path for r in chosen.collect()) == sorted([files[2]["path"], files[3]["path"], files[4]["path"]])


def test_whole_job(spark, raw, tmp_path, day):
    out = str(tmp_path / "out")
    assert pipeline.run(spark, raw, out, "2025-06-30") == {
        "market_data": (5, 5),
        "underlying_apr": (2, 1),
        "settlement": (1, 0),
        "ohlcv_1d": (1, 0),
    }
    comparison = tables.read_table(spark, f"{out}/apr_comparison_daily").where(F.col("market") == MARKET)
    assert sorted(rows_of(comparison, "date", "samples", "impliedApr", "realizedForwardApr", "forwardDaysUsed")) == [
        (day("2025-01-01"), 3, pytest.approx(0.2), pytest.approx(0.06), 2),
        (day("2025-01-02"), 1, 0.2, pytest.approx(0.07), 1),
    ]
    assert tables.read_table(spark, f"{out}/market_summary").count() == 1
    assert tables.read_table(spark, f"{out}/site_summary").count() == 2
    payload = tables.read_table(spark, f"{out}/site_markets_json", "json").where(F.col("market") == MARKET).collect()[0]
    assert len(payload.series) == 2 and payload.ohlcv[0].v == 12.0 and payload.series[0].ss == 1
    assert {r.reject_reason for r in pipeline.rejected_lines(spark, raw).collect()} >= {"funding file name holds no asset"}


def test_clean_counts_include_empty_tables(spark):
    empty = spark.createDataFrame([], "x int")
    assert sorted(rows_of(clean.table_row_counts({"a": empty, "b": spark.range(3)}))) == [("a", 0), ("b", 3)]


def test_ingest_of_an_absent_folder(spark, tmp_path):
    table = str(tmp_path / "t")
    ingest.append_new(spark, str(tmp_path / "raw"), clean.SETTLEMENT, table, str(tmp_path / "c")).awaitTermination()


def test_incremental_ingest_reads_new_archives_once(spark, raw, tmp_path):
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")

    def rows_after_run():
        ingest.append_new(spark, raw, clean.SETTLEMENT, table, checkpoint).awaitTermination()
        return spark.read.parquet(table).count()

    assert rows_after_run() == 1
    assert rows_after_run() == 1
    from pathlib import Path

    write_archive(Path(raw) / "settlement" / MARKET / "new.ndjson.zip", {"x": [{"timestamp": DAY2}, {"timestamp": DAY1}]})
    assert rows_after_run() == 3
