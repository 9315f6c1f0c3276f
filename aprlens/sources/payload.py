"""Nested market payload: one JSON object per market."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def _not_finite(value: Column, dtype: T.DataType) -> Column | None:
    """True where a double anywhere inside ``value`` is NaN or infinite; None for a type without doubles."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.abs(value) >= F.lit(float("inf"))
    if isinstance(dtype, T.StructType):
        parts = [_not_finite(value[f.name], f.dataType) for f in dtype.fields]
        parts = [F.coalesce(p, F.lit(False)) for p in parts if p is not None]
        return F.greatest(*parts, F.lit(False)) if parts else None
    if isinstance(dtype, T.ArrayType):
        if _not_finite(F.lit(None), dtype.elementType) is None:
            return None
        return F.exists(value, lambda x: F.coalesce(_not_finite(x, dtype.elementType), F.lit(False)))
    return None


def require_finite(df: DataFrame) -> DataFrame:
    """The same rows; a job that reads a row holding NaN or infinity fails, as JSON has no such number."""
    checks = [_not_finite(F.col(f.name), f.dataType) for f in df.schema.fields]
    checks = [F.coalesce(c, F.lit(False)) for c in checks if c is not None]
    if not checks:
        return df
    bad = F.greatest(*checks, F.lit(False))
    return df.where(F.when(bad, F.raise_error(F.lit("payload holds a number that is not finite"))).otherwise(True))


def write_payload(df: DataFrame, path: str) -> None:
    """Newline-delimited JSON, one row each, missing values written as null, sorted by the first column."""
    key = df.columns[0]
    require_finite(df).orderBy(key).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _object(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _joined(names: list[str]):
    """A task's sorted entries as pieces of text, one piece an Arrow batch; ``names`` are those of the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at, first, lines = object(), 0, True, 0

        def up_to(part: int) -> str:
            opened = [f'"{name}":[' for name in names[at:part]]
            return ("]," if at else ",") + "],".join(opened)

        def end() -> str:
            return (up_to(len(names)) if at < len(names) else "") + "]}"

        for batch in batches:
            pieces = []
            for key, part, text in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "text"))):
                if part == 0:
                    if key == current:
                        raise ValueError(f"payload holds two objects of {key!r}")
                    pieces.append(end() + "\n" + text if lines else text)
                    current, at, first, lines = key, 0, True, lines + 1
                elif key == current:
                    if at < part:
                        pieces.append(up_to(part))
                        at, first = part, True
                    pieces.append(text if first else "," + text)
                    first = False
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array(["".join(pieces)], pa.string())], ["text"])
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([end()], pa.string())], ["text"])

    return run


def nested_text(heads: DataFrame, lists: dict[str, DataFrame], order: str) -> DataFrame:
    """Pieces of JSON lines: each row of ``heads`` with, under the names of ``lists``, arrays of the lists' rows of its key.

    The key is the first column of ``heads`` and is left out of the arrays' objects. Arrays ascend by ``order`` (missing
    first), equal ones by their text. A list's rows whose key no head has are left out; a key without rows gets an empty
    array; a repeated head fails the job. Entries move once, as text, by ranges of the key, and are joined as they come
    out of the sort: a task holds one batch of them, never an array.
    """
    key = heads.columns[0]
    opening = F.expr("left(text, length(text) - 1)").alias("text")
    none = F.lit(None).cast(lists[next(iter(lists))].schema[order].dataType)
    entries = [
        require_finite(heads)
        .select(F.col(key).alias("key"), F.lit(0).alias("part"), none.alias("place"), _object(heads.columns).alias("text"))
        .select("key", "part", "place", opening)
    ]
    for part, rows in enumerate(lists.values(), 1):
        fields = [c for c in rows.columns if c != key]
        entries.append(
            require_finite(rows).select(
                F.col(key).alias("key"), F.lit(part).alias("part"), F.col(order).alias("place"), _object(fields).alias("text")
            )
        )
    rows = reduce(DataFrame.unionByName, entries)
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "part", "place", "text")
    return rows.select("key", "part", "text").mapInArrow(_joined(list(lists)), "text string")


def write_nested(heads: DataFrame, lists: dict[str, DataFrame], order: str, path: str) -> None:
    """:func:`nested_text` as newline-delimited JSON, ascending by key over all files. Blanks separate the pieces, where
    JSON allows them."""
    nested_text(heads, lists, order).write.mode("overwrite").option("lineSep", " ").text(path)
