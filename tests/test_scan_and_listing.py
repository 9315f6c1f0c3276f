"""Segmented running sums against a window, and listings made by tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from aprlens.operators.charts import running_diff_by_month
from aprlens.operators.scan import running_sums
from aprlens.sources import archives, manifest
from tests.conftest import rows_of


def rounded(df):
    return sorted(map(str, df.select(*[F.round(c, 9).alias(c) if k == "double" else c for c, k in df.dtypes]).collect()))


def test_running_sums_equal_a_window_with_one_hot_key(spark):
    rng = random.Random(9)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows = [(rng.choice(keys), i, rng.choice([None, rng.random(), rng.random()])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, x double").repartition(5)
    sums = {"total": F.col("x"), "n": F.when(F.col("x").isNotNull(), 1)}
    found = running_sums(df, ["k"], ["at"], F.floor(F.col("at") / 40), sums)
    whole = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.withColumns({"total": F.sum("x").over(whole), "n": F.sum(sums["n"]).over(whole)})
    assert found.columns == expected.columns and rounded(found) == rounded(expected)
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    for line in windows:  # over rows: key and block; over a key alone: block totals
        assert "_block" in line.split("], [")[1] or "_total" in line, line


def test_running_diff(spark, day):
    rows = [("m", day("2025-01-31"), 1.0), ("m", day("2025-02-01"), None), ("m", day("2025-02-02"), 2.0), ("m", day("2025-03-05"), float("nan")), ("n", day("2025-01-01"), 5.0)]
    out = running_diff_by_month(spark.createDataFrame(rows, "market string, d date, diff double"))
    assert sorted(rows_of(out, "market", "d", "sum"), key=str) == [
        ("m", day("2025-01-31"), 1.0), ("m", day("2025-02-01"), None), ("m", day("2025-02-02"), 3.0),
        ("m", day("2025-03-05"), None), ("n", day("2025-01-01"), 5.0),
    ]


@pytest.fixture
def tree(tmp_path):
    names = ["top.txt", "a/one", "a/b/two %20#", "a/b/c/d/three", "e f/g/four", "e f/empty/"]
    for k, name in enumerate(names):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        if not name.endswith("/"):
            (tmp_path / "r" / name).write_bytes(b"x" * (k + 1))
    (tmp_path / "r" / "e f" / "empty").mkdir()
    return tmp_path / "r"


@pytest.mark.parametrize("levels", [0, 1, 2, 5])
def test_tasks_list_what_the_driver_lists(spark, tree, levels):
    by_tasks = sorted(rows_of(archives.list_tree(spark, str(tree), 3, levels), "path", "length"))
    assert by_tasks == sorted(rows_of(archives.list_files(spark, str(tree), "*"), "path", "length")) and len(by_tasks) == 5
    assert archives.list_tree(spark, str(tree / "absent"), 3, levels).count() == 0


def test_kept_listings_are_compared(spark, tree, tmp_path):
    table = str(tmp_path / "listing")
    manifest.write_listing(spark, str(tree), table, 1)
    (tree / "a" / "one").write_bytes(b"longer")
    (tree / "new").write_bytes(b"n")
    (tree / "top.txt").unlink()
    manifest.write_listing(spark, str(tree), table, 2)
    changes = manifest.listing_changes(spark, table, 1, 2)
    assert sorted(rows_of(changes)) == [("a/one", "resized", 6), ("new", "added", 1), ("top.txt", "removed", 1)]
    assert manifest.listing_changes(spark, table, 2, 2).count() == 0
