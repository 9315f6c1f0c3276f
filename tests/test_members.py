"""Archives read by member: the central directory by range, each member by the task that gets it."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from aprlens.operators import clean
from aprlens.sources import archives
from tests.conftest import rows_of, write_archive

DAY = 1735689600
FOLDER = "settlement/5-OKX-BTCUSDT-31JAN2025"


@pytest.fixture
def many(tmp_path):
    members = {f"m{k}.ndjson": [{"timestamp": DAY + 60 * i, "settlementApr": k / 100, "txHash": f"{k}-{i}"} for i in range(20)] for k in range(50)}
    write_archive(tmp_path / FOLDER / "many.ndjson.zip", {"empty/": [], "none.ndjson": [], **members})
    write_archive(tmp_path / FOLDER / "hash # and %20.ndjson.zip", {"one": [{"timestamp": DAY}]})
    return str(tmp_path)


def lines(spark, root, ranged):
    blocks = archives.scan_archives(spark, root, "settlement", ranged)
    return clean.lines_of(clean_input := blocks, clean.SETTLEMENT), clean_input


def test_members_are_shared_among_tasks(spark, many):
    by_member, blocks = lines(spark, many, True)
    whole, _ = lines(spark, many, False)
    columns = ["source_path", "timestamp", "settlementApr", "txHash"]
    read = clean.clean_settlement(by_member)
    assert read.count() == 1001
    assert sorted(rows_of(read, *columns), key=str) == sorted(rows_of(clean.clean_settlement(whole), *columns), key=str)
    assert blocks.where("source_path like '%many%'").select(F.spark_partition_id()).distinct().count() > 1


def test_archives_beyond_sparks_limit_are_read(spark, many):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        assert clean.clean_settlement(lines(spark, many, None)[0]).count() == 1001
        with pytest.raises(Exception, match="(?i)maxLength|max length|exceeds"):
            clean.clean_settlement(lines(spark, many, False)[0]).count()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_all_ways_to_pack_a_member(spark, tmp_path):
    path = tmp_path / FOLDER / "ways.ndjson.zip"
    path.parent.mkdir(parents=True)
    with open(path, "wb") as out:
        out.write(b"something before the archive")
    with zipfile.ZipFile(path, "a") as archive:
        for way in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA):
            archive.writestr(f"way{way}", f'{{"timestamp": {DAY}, "txHash": "{way}"}}\n', compress_type=way)
        with archive.open("streamed", "w", force_zip64=True) as member:
            member.write(b'{"timestamp": %d, "txHash": "long"}' % DAY)
    found = clean.clean_settlement(lines(spark, str(tmp_path), True)[0])
    assert sorted(r.txHash for r in found.collect()) == ["0", "12", "14", "8", "long"]


def test_a_bad_member_does_not_take_others_with_it(spark, tmp_path):
    path = tmp_path / FOLDER / "part.ndjson.zip"
    write_archive(path, {f"m{k}": [{"timestamp": DAY + k}] * 50 for k in range(3)})
    with zipfile.ZipFile(path) as archive:
        start = archive.getinfo("m1").header_offset
    content = bytearray(path.read_bytes())
    content[start + 34 : start + 50] = bytes(16)
    path.write_bytes(content)
    read = lines(spark, str(tmp_path), True)[0]
    assert {r.timestamp for r in clean.clean_settlement(read).collect()} >= {DAY, DAY + 2}
    (row,) = clean.rejected(read, clean.SETTLEMENT).where("reject_reason like 'archive%'").collect()
    assert row.source_path.endswith("part.ndjson.zip")
