"""Exact percentiles and modes of groups too large for one task.

``percentile`` and ``mode`` gather a group's distinct values in one buffer. Here values are counted by value first, which
tasks reduce before the shuffle. Blocks of values are added up, which tells the blocks that hold the wanted ranks; only
values of those are put in order. Blocks are cut at approximate quantiles of all groups' values together, so a block of one
group has at most a block's share of all: where the cuts lie changes the work, not the result.

All readers of the counts name the same columns and compare keys null-safely, so that Spark counts once for all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import finite

BLOCKS = 256  # a task puts about that share of the distinct values in order
RUN = 16  # cuts passed over at once where the last of them lies below the value


def value_counts(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``keys, value, n``: how often each finite value occurs."""
    found = rows.select(*keys, (finite(value.cast("double")) + F.lit(0.0)).alias("value"))  # no -0.0 beside 0.0
    return found.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def percentiles(counts: DataFrame, keys: list[str], points: dict[str, float], blocks: int = BLOCKS) -> DataFrame:
    """Interpolated percentiles by name, of :func:`value_counts`. Groups without a finite value have no row."""
    cuts = F.percentile_approx(
        F.when(F.col("n") > 0, F.col("value")), F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), F.lit(20 * blocks)
    )
    ends = F.filter("_cuts", lambda _, i: i % RUN == RUN - 1)
    one_row = counts.agg(cuts.alias("_cuts")).select("_cuts", ends.alias("_ends"))

    def below(cuts: Column | str) -> Column:
        return F.size(F.filter(cuts, lambda cut: cut < F.col("value")))

    placed = counts.crossJoin(F.broadcast(one_row)).withColumn("_passed", below("_ends") * RUN)
    block = F.col("_passed") + below(F.slice("_cuts", F.col("_passed") + 1, RUN))
    placed = placed.select(*keys, "value", "n", block.alias("_block"))
    totals = placed.groupBy(*keys, "_block").agg(F.sum("n").alias("_total"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumns(
        {"_before": F.coalesce(F.sum("_total").over(earlier), F.lit(0)), "_all": F.sum("_total").over(group)}
    )
    ends_of = [rank(F.lit(p) * (F.col("_all") - 1)) for p in points.values() for rank in (F.floor, F.ceil)]
    held = [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_total")) for r in ends_of]
    at = [*keys, "_block"]
    wanted = starts.where(reduce(lambda a, b: a | b, held)).select(
        *[F.col(c).alias(f"_of{i}") for i, c in enumerate(at)], "_before", "_all"
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(at)])
    inside = Window.partitionBy(*at).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(wanted, same).withColumn("_upto", F.col("_before") + F.sum("n").over(inside))
    picked = {}
    for name, point in points.items():
        at = F.lit(point) * (F.col("_all") - 1)
        for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            picked[f"_{name}_{end}"] = F.min(F.when(F.col("_upto") > rank, F.col("value")))
    out = ranked.groupBy(*keys).agg(F.max("_all").alias("_all"), *[c.alias(n) for n, c in picked.items()])

    def between(name: str, point: float) -> Column:
        at = F.lit(point) * (F.col("_all") - 1)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        return (low + (at - F.floor(at)) * (high - low)).alias(name)

    return out.select(*keys, *[between(n, p) for n, p in points.items()])


def modes(counts: DataFrame, keys: list[str], name: str = "mode") -> DataFrame:
    """The most frequent value of each group, the smallest on ties; of :func:`value_counts`."""
    best = F.max(F.struct("n", (-F.col("value")).alias("low")))
    return counts.groupBy(*keys).agg(best.alias("_best")).select(*keys, (-F.col("_best.low") + F.lit(0.0)).alias(name))
