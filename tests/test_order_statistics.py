"""Percentiles and modes by counts against Spark's own, with one group of most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from aprlens.functions import numeric
from aprlens.operators import order


@pytest.mark.parametrize("blocks", [2, 16])
def test_percentiles_and_modes_equal_the_aggregates(spark, blocks):
    rng = random.Random(12)
    values = [None, float("nan"), float("inf"), -0.0, *[round(rng.gauss(0, 1), 2) for _ in range(60)]]
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), rng.choice(values)) for _ in range(1500)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    points = {"p10": 0.1, "p50": 0.5, "p99": 0.99, "low": 0.0, "high": 1.0}
    counts = order.value_counts(df, ["k"], F.col("x"))
    found = {r["k"]: tuple(r)[1:] for r in order.percentiles(counts, ["k"], points, blocks).collect()}
    mode = {r["k"]: r["mode"] for r in order.modes(counts, ["k"]).collect()}
    own = numeric.quantiles(F.col("x"), list(points.values()))
    expected = df.groupBy("k").agg(own.alias("points"), numeric.smallest_mode(numeric.finite(F.col("x")) + 0.0).alias("mode")).collect()
    for r in expected:
        if r["points"] is None:
            assert r["k"] not in found and r["k"] not in mode
        else:
            assert found[r["k"]] == pytest.approx(tuple(r["points"])) and mode[r["k"]] == r["mode"]
    whole = order.percentiles(order.value_counts(df, [], F.col("x")), [], {"p50": 0.5}, blocks).collect()
    assert whole[0]["p50"] == pytest.approx(df.agg(numeric.quantiles(F.col("x"), [0.5])).first()[0][0])


def test_rows_are_counted_once_for_percentiles_and_modes(spark, tmp_path):
    from aprlens.bindings import queries

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows reuse before it runs
    try:
        plan = queries.line_percentiles(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("FileScan") == 1
