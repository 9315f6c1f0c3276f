"""Running sums of keys too large for one task: block totals, carries, and sums inside blocks.

A window over a whole key sorts all its rows in one task. Here a key is cut into blocks (a day, a month): tasks add up
their rows' blocks before the shuffle, a window over block totals, one row a block, gives what each block starts with,
and the rows are summed within their block alone. The largest group of rows any task holds is one block of one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sums(rows: DataFrame, keys: list[str], order: list[str], block: Column, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with a running sum of each of ``sums`` over ``keys`` by ``order``, the row itself included.

    ``block`` has to grow with ``order``: all rows of a block lie before those of a later one. As with a window, NULL adds
    nothing, the sum is NULL until the first value, and rows equal in ``order`` come in any order. Keys and blocks may be
    NULL.
    """
    values = {f"_value{i}": v for i, v in enumerate(sums.values())}
    rows = rows.withColumns({"_block": block, **values})
    at = [*keys, "_block"]
    totals = rows.groupBy(*at).agg(*[F.sum(v).alias(f"_total{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(*keys).orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(c).alias(f"_of{i}") for i, c in enumerate(at)],
        *[F.sum(f"_total{i}").over(before).alias(f"_before{i}") for i in range(len(values))],
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(at)])
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({f"_inside{i}": F.sum(v).over(inside) for i, v in enumerate(values)}).join(carried, same)
    zero = F.lit(0)
    made = {
        name: F.coalesce(
            F.col(f"_before{i}") + F.coalesce(f"_inside{i}", zero), F.col(f"_before{i}"), F.col(f"_inside{i}")
        )
        for i, name in enumerate(sums)
    }
    own = [c for c in rows.columns if c != "_block" and c not in values]
    return summed.select(*own, *[v.alias(n) for n, v in made.items()])
