"""Tables at rest: Parquet by default, CSV for exchange.

A table that is read by day and market is laid out for it: a folder per month, each folder's files cut by ranges of
(market, day) and sorted inside, so that a filter on either reads few files. Where the job's tables are joined market by
market, a catalog table with buckets spares those joins their shuffles.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MONTH = "month"


def write_table(df: DataFrame, path: str, fields: list[str] | None = None, fmt: str = "parquet") -> None:
    """Write ``fields`` in that order; columns not named are left out, NULL is an empty CSV field."""
    if fields:
        df = df.select(*fields)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    else:
        writer.format(fmt).save(path)


def write_sorted(df: DataFrame, path: str, order: list[str], fields: list[str] | None = None, fmt: str = "parquet") -> None:
    """:func:`write_table` in the order of ``order``, over all files: each holds a run of it, however the rows are spread."""
    write_table(df.repartitionByRange(*order).sortWithinPartitions(*order), path, fields, fmt)


def staged_split(df: DataFrame, flag: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows where ``flag`` is false and where it is true, by one pass over ``df``, which is written to ``path``; the
    caller drops that folder when both sides are written."""
    df.write.mode("overwrite").partitionBy(flag).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    return staged.where(~F.col(flag)).drop(flag), staged.where(F.col(flag)).drop(flag)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", fields: list[str] | dict[str, str] | None = None
) -> DataFrame:
    """``fields`` matter to CSV only: named ones spare the pass over the header, and come back as text unless a
    type is given with the name."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    reader = spark.read.option("header", True).option("inferSchema", False)
    if fields:
        types = fields if isinstance(fields, dict) else dict.fromkeys(fields, "string")
        reader = reader.schema(", ".join(f"`{name}` {kind}" for name, kind in types.items()))
    return reader.csv(path)


def read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none yet. With a ``schema`` no file is opened to find it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def month_of(day: str | Column = "date") -> Column:
    return F.trunc(day, "month")


def write_months(df: DataFrame, path: str, order: list[str], day: str = "date", within: list[str] | None = None) -> None:
    """Replace the months that ``df`` has rows of, and no others, in the table at ``path``.

    Rows are dealt by range of (month, ``order``): a month or a market that holds most rows is cut into several files,
    and each file holds a run of the order. ``within`` names further partition columns below the month: then only those
    (month, ...) folders are replaced that ``df`` has rows of.
    """
    parts = [MONTH, *(within or [])]
    keys = [*parts, *order]
    rows = df.withColumn(MONTH, month_of(day)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def read_months(spark: SparkSession, path: str, months: list | None = None) -> DataFrame:
    """The table without its partition column; of ``months`` only where given, which prunes the other folders."""
    rows = spark.read.parquet(path)
    if months is not None:
        rows = rows.where(F.col(MONTH).isin(months))
    return rows.drop(MONTH)


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, by: list[str], order: list[str]) -> None:
    """A catalog table over files at ``path``, hashed into ``buckets`` by ``by`` and sorted inside.

    Rows are dealt by the same hash first, so each bucket is one file. Jobs that group or join by ``by`` then need no
    exchange; for joins on more columns than these, ``spark.sql.requireAllClusterKeysForCoPartition`` has to be false.
    The catalog keeps the layout: later sessions need the same metastore.
    """
    rows = df.repartition(buckets, *by).sortWithinPartitions(*by, *order)
    writer = rows.write.mode("overwrite").option("path", path).bucketBy(buckets, *by)
    writer.sortBy(*by, *order).saveAsTable(name)
