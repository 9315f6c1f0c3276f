"""Cleans only the archives that landed since the last run.

The file source remembers in its checkpoint which archives it has read, so every run takes the new ones and stops.
Decoding, parsing and typing are those of the batch job. One pass over a batch of archives writes its accepted lines to
``<table>/batch=N`` and its rejected ones to ``<table>_rejected/batch=N``; then ``<table>_ledger`` gets an entry with both
counts. A batch that is run again after a failure replaces all three, so that no line is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import Dataset, lines_of, write_checked
from ..sources.archives import ARCHIVE_GLOB, LISTING_SCHEMA, RANGED_STORES, placed, scan_archives, scan_whole, scheme_of
from ..sources.tables import read_or_none

LEDGER_SCHEMA = "batch long, accepted long, rejected long"


def new_archives(spark: SparkSession, root: str, dataset: Dataset) -> DataFrame:
    """Archives as they appear below the dataset's folder, which is made if it is absent: there is nothing in it yet.
    Their content is read only where a job asks for it."""
    folder = f"{root.rstrip('/')}/{dataset.prefix}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return (
        spark.readStream.format("binaryFile")
        .schema(LISTING_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", ARCHIVE_GLOB)
        .load(folder)
    )


def write_batch(lines: DataFrame, dataset: Dataset, table: str, batch: int, strict: bool = False) -> None:
    """Accepted and rejected lines of one batch, then its entry in the ledger; all replace what an earlier attempt of the
    same batch left."""
    seen = Observation()
    write_checked(lines, dataset, f"{table}/batch={batch}", f"{table}_rejected/batch={batch}", seen, strict)
    entry = [(batch, seen.get["accepted"], seen.get["rejected"])]
    found = lines.sparkSession.createDataFrame(entry, LEDGER_SCHEMA).coalesce(1)
    found.drop("batch").write.mode("overwrite").parquet(f"{table}_ledger/batch={batch}")


def append_new(
    spark: SparkSession, root: str, dataset: Dataset, table: str, checkpoint: str, strict: bool = False
) -> StreamingQuery:
    """Clean new archives into batches of ``table`` and stop; the caller awaits the query."""
    ranged = scheme_of(spark, root) in RANGED_STORES

    def run(files: DataFrame, batch: int) -> None:
        if ranged:
            blocks = scan_archives(files.sparkSession, root, dataset.prefix, True, files)
        else:
            blocks = placed(scan_whole(files), files.sparkSession, root)
        write_batch(lines_of(blocks, dataset), dataset, table, batch, strict)

    # Without the content where tasks fetch it themselves: else Spark would read the archives, too.
    files = new_archives(spark, root, dataset)
    files = files.select("path", "length") if ranged else files.select("path", "length", "content")
    return (
        files.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ledger(spark: SparkSession, table: str) -> DataFrame:
    """``batch, accepted, rejected`` of every batch that was written to its end."""
    found = read_or_none(spark, f"{table}_ledger")
    if found is None:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return found.select(F.col("batch").cast("long"), "accepted", "rejected")


def batches_of(spark: SparkSession, table: str) -> list[int]:
    return sorted(r["batch"] for r in ledger(spark, table).select("batch").collect())


def accepted_lines(spark: SparkSession, dataset: Dataset, table: str, batches: list[int] | None = None) -> DataFrame:
    """The clean lines of the ledger's batches, or of some of them; other folders are not read."""
    known = set(batches_of(spark, table))
    wanted = sorted(known if batches is None else known & set(batches))
    if not wanted:
        kinds = ", ".join(f"`{c}` {k}" for c, k in dataset.types.items())
        return spark.createDataFrame([], kinds)
    return spark.read.parquet(table).where(F.col("batch").isin(wanted)).select(*dataset.columns)


def rejected_lines(spark: SparkSession, table: str) -> DataFrame:
    """``batch, source_path, reject_reason, line`` of the lines no clean table has."""
    wanted = batches_of(spark, table)
    if not wanted:
        return spark.createDataFrame([], "batch int, source_path string, reject_reason string, line string")
    found = spark.read.parquet(f"{table}_rejected").where(F.col("batch").isin(wanted))
    return found.select("batch", "source_path", "reject_reason", "line")
