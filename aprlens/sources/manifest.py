"""File manifest: which files a run wants and which of them still have to be fetched."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .archives import RANGED_STORES, below, list_files, list_tree, scheme_of

MANIFEST_SCHEMA = "path string, size long"

# The dataset prefixes of a run.
DEFAULT_DATASETS = ["market-data", "settlement", "underlying-apr", "ohlcv/1d"]
TRADES = "market-trades"
ORDER_BOOK = "order-book"

BYTES_PER_MB = 1024 * 1024


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``{path, size}`` objects."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)


def dataset_prefixes(
    include: list[str] | None = None, trades: bool = False, order_book: bool = False
) -> list[str]:
    """``include`` replaces the default prefixes; the two switches add to either."""
    return [*(include or DEFAULT_DATASETS), *([TRADES] if trades else []), *([ORDER_BOOK] if order_book else [])]


def under_prefix(path: Column, prefix: str) -> Column:
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def select_files(
    manifest: DataFrame, include: list[str] | None = None, trades: bool = False, order_book: bool = False
) -> DataFrame:
    prefixes = dataset_prefixes(include, trades, order_book)
    return manifest.where(reduce(or_, [under_prefix(F.col("path"), p) for p in prefixes]))


def landed_files(spark: SparkSession, root: str) -> DataFrame:
    """Path below ``root`` and size of every file there; reads the listing, not the files. Tasks list the folders where
    they can open the store themselves, else the driver does."""
    found = list_tree(spark, root) if scheme_of(spark, root) in RANGED_STORES else list_files(spark, root, "*")
    return found.select(below(F.col("path"), root, spark).alias("path"), F.col("length").alias("size"))


def write_listing(spark: SparkSession, root: str, path: str, batch: int) -> None:
    """The listing of one moment as a partition of the table at ``path``, in the place of an earlier attempt's."""
    landed_files(spark, root).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def listing_changes(spark: SparkSession, path: str, before: int, after: int) -> DataFrame:
    """``path, change, size``: files ``added``, ``removed`` or ``resized`` between two kept listings, of which only these
    two partitions are read."""
    listed = spark.read.schema(f"{MANIFEST_SCHEMA}, batch long").parquet(path)
    old, new = (listed.where(F.col("batch") == b).select("path", F.col("size").alias(n)) for b, n in ((before, "old"), (after, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("resized")
    met = old.join(new, "path", "full").where("NOT old <=> new")
    return met.select("path", change.alias("change"), F.coalesce("new", "old").alias("size"))


def pending_files(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """Wanted files without a landed file of the same path and size."""
    return wanted.join(landed.select("path", "size"), ["path", "size"], "left_anti")


def transfer_summary(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """Files and megabytes per status: ``skipped`` is landed already, ``pending`` is not."""
    have = landed.select("path", "size").distinct().withColumn("landed", F.lit(True))
    status = F.when(F.col("landed"), "skipped").otherwise("pending")
    return (
        wanted.join(have, ["path", "size"], "left")
        .groupBy(status.alias("status"))
        .agg(F.count(F.lit(1)).alias("files"), (F.sum("size") / BYTES_PER_MB).alias("megabytes"))
    )
