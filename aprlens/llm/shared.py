"""Helpers of the operators: written intermediate tables, numbering, connected components, table access."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

INDEX_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one if there
    is but one machine (master ``local``), else an error: other machines would not see it."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. Whoever owns that folder clears it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "slot") -> DataFrame:
    """Adds the gapless 0-based row number within ``group`` by ``order``.

    Rows are dealt by range of (group, order), so a group of any size is spread over tasks; only the count of
    each (group, partition) meets elsewhere. ``group`` must have few values: that table has at most
    partitions + groups rows and is broadcast.
    """
    keys = [*group, *order]
    placed = (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    )
    placed = kept(placed, "numbered").withColumn("_part", F.shiftrightunsigned("_at", INDEX_BITS))
    runs = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_run"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("_part") == F.col("_run")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(F.broadcast(runs), same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """``id``, ``component`` (the smallest id reachable) for every id in ``edges`` (long columns ``a``, ``b``).

    Alternating star contraction: each node hands its neighbours to the smallest of them, first the larger
    neighbours, then the smaller ones, until all edges lead straight to a smallest id. A hub is only ever a join key
    or a partial minimum, never one collected list, and each pass is a written table. Equal ends and repeated edges
    are allowed.
    """

    def settled(star: DataFrame) -> bool:
        """No id with two smaller neighbours, and no smaller neighbour with one of its own."""
        several = star.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low < high")
        if not several.isEmpty():
            return False
        return star.select(F.col("b").alias("a")).join(star.select("a"), "a", "left_semi").isEmpty()

    def contracted(pairs: DataFrame, larger: bool) -> DataFrame:
        # pairs: (a, b) with a > b, each once.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        met = both.join(least, F.col("a") == F.col("node"))
        if larger:
            moved = met.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        else:
            moved = met.select(F.col("b").alias("a"), F.col("root").alias("b"))
            moved = moved.unionByName(least.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return moved.where("a <> b").distinct()

    star = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    star = kept(star, "star")
    for _ in range(limit):
        if settled(star):
            break
        star = kept(contracted(contracted(star, True), False), "star")
    else:
        raise RuntimeError(f"components did not settle in {limit} passes")
    roots = star.select(F.col("a").alias("id"), F.col("b").alias("component"))
    alone = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return alone.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def least_roots(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that rows ``a`` and columns ``b`` reach through the links (i, j) of one block pair."""
    a, b = a.copy(), b.copy()
    by_j = np.argsort(j, kind="stable")
    rows, row_at = np.unique(i, return_index=True)
    columns, column_at = np.unique(j[by_j], return_index=True)
    while len(i):
        was = a[rows].sum() + b[columns].sum()
        a[rows] = np.minimum(a[rows], np.minimum.reduceat(b[j], row_at))
        b[columns] = np.minimum(b[columns], np.minimum.reduceat(a[i[by_j]], column_at))
        if a[rows].sum() + b[columns].sum() == was:
            break
    return a, b
