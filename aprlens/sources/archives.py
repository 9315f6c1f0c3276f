"""Scan of zipped newline-delimited JSON.

An archive's central directory says where its members lie. Tasks read the directories by range, the members found are dealt
anew, and each is inflated as a stream by the task that gets it, so an archive of any size is read by as many tasks as it
has members. Python only inflates: it hands blocks of whole lines back to Spark, which splits, checks and parses them.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import permissive_double

ARCHIVE_GLOB = "*.ndjson.zip"
ARCHIVE_SUFFIX = ".ndjson.zip"
LISTING_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
BLOCK_SCHEMA = pa.schema([("path", pa.string()), ("block", pa.binary()), ("problem", pa.string())])
MEMBER_SCHEMA = "path string, start long, packed long, size long, crc long, method int, flags int, problem string"
BLOCK_BYTES = 1 << 20
TASK_BYTES = 128 << 20
# The length and fields of the header before a member's content.
MEMBER_HEADER, MEMBER_MAGIC = struct.Struct("<4s22xHH"), b"PK\x03\x04"
# Stores that tasks open themselves, by range; archives in others are read whole by Spark.
RANGED_STORES = {"file", "s3", "s3a", "gs"}
UNREADABLE = (
    zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, struct.error, pa.ArrowInvalid,
)
BAD_LINE = "_bad_line"


def list_files(spark: SparkSession, path: str, glob: str = ARCHIVE_GLOB) -> DataFrame:
    """Files below ``path`` at any depth; an absent directory has none. Unselected content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTING_SCHEMA)


def _listed(recursive: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folders of ``path`` read one level deep or to the bottom; files are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
                if length is not None:
                    yield pa.record_batch([pa.array([path]), pa.array([length], pa.int64())], ["path", "length"])
                    continue
                store, base, start = located(path)
                found = store.get_file_info(fs.FileSelector(start, recursive=recursive, allow_not_found=True))
                found = [f for f in found if f.type == fs.FileType.File or not recursive]
                paths = [path[: len(path) - len(start.removeprefix(base))] + f.path.removeprefix(base) for f in found]
                sizes = [f.size if f.type == fs.FileType.File else None for f in found]
                yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "length"])

    return run


def list_tree(spark: SparkSession, root: str, tasks: int | None = None, levels: int = 2) -> DataFrame:
    """``path, length`` of every file below ``root``, listed by tasks: the driver names the root only.

    ``levels`` folders deep the folders are dealt anew, below that each is listed to its bottom by one task. For the
    stores that tasks open themselves; an absent root has no files.
    """
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    found = spark.createDataFrame([(whole, None)], "path string, length long")
    for _ in range(levels):
        found = found.mapInArrow(_listed(False), "path string, length long").repartition(tasks, "path")
    return found.mapInArrow(_listed(True), "path string, length long")


def _member_blocks(handle) -> Iterator[bytes]:
    """Blocks of whole lines of every member that is not a directory."""
    with zipfile.ZipFile(handle) as archive:
        for member in archive.infolist():
            if member.is_dir():
                continue
            with archive.open(member) as lines:
                while block := lines.read(BLOCK_BYTES):
                    yield block + lines.readline()


def _as_batch(path: str, block: bytes | None, problem: str | None = None) -> pa.RecordBatch:
    return pa.record_batch([[path], [block], [problem]], schema=BLOCK_SCHEMA)


def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of lines; an archive that cannot be read to its end yields a row with the ``problem`` last."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                for block in _member_blocks(pa.BufferReader(content.as_buffer())):
                    yield _as_batch(path.as_py(), block)
            except UNREADABLE as error:
                yield _as_batch(path.as_py(), None, f"{type(error).__name__}: {error}")


@lru_cache(maxsize=16)
def _store(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
    if scheme == "file":
        return fs.LocalFileSystem(), ""
    store, base = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{authority}/")
    return store, base.rstrip("/")


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a listed path, what the store's own paths begin with, and the store's own path."""
    scheme, authority, rest = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)", path, re.DOTALL).groups()
    store, base = _store(scheme, authority or "")
    return store, base, base + rest


def open_at(path: str) -> pa.NativeFile:
    """A listed file, for reads by range."""
    store, _, own = located(path)
    return store.open_input_file(own)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per member, from the archive's central directory alone; a row with the ``problem`` where there is none."""
    names = [f.split()[0] for f in MEMBER_SCHEMA.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.int32()] * 2, pa.string()]
    for batch in batches:
        for path in batch["path"].to_pylist():
            try:
                with open_at(path) as handle, zipfile.ZipFile(handle) as archive:
                    found = [
                        (path, m.header_offset, m.compress_size, m.file_size, m.CRC, m.compress_type, m.flag_bits, None)
                        for m in archive.infolist()
                        if not m.is_dir()
                    ]
            except UNREADABLE as error:
                found = [(path, *[None] * 6, f"{type(error).__name__}: {error}")]
            if found:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)


def _member_stream(handle: pa.NativeFile, start: int, packed: int, size: int, crc: int, method: int, flags: int):
    """The content of the member whose header begins at ``start``; its checksum is checked at the end."""
    handle.seek(start)
    magic, name, extra = MEMBER_HEADER.unpack(handle.read(MEMBER_HEADER.size))
    if magic != MEMBER_MAGIC:
        raise zipfile.BadZipFile("no member where the directory says")
    if flags & 1:
        raise RuntimeError("member is encrypted")
    handle.seek(start + MEMBER_HEADER.size + name + extra)
    info = zipfile.ZipInfo()
    info.compress_size, info.file_size, info.CRC, info.compress_type, info.flag_bits = packed, size, crc, method, flags
    return zipfile.ZipExtFile(handle, "r", info)


def _inflate_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of lines of each member; one that cannot be read to its end yields a row with the ``problem`` last."""
    for batch in batches:
        for path, *where, problem in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if problem is not None:
                yield _as_batch(path, None, problem)
                continue
            try:
                with open_at(path) as handle, _member_stream(handle, *where) as lines:
                    while block := lines.read(BLOCK_BYTES):
                        yield _as_batch(path, block + lines.readline())
            except UNREADABLE as error:
                yield _as_batch(path, None, f"{type(error).__name__}: {error}")


def list_members(files: DataFrame) -> DataFrame:
    """Where every member of the listed archives lies (:data:`MEMBER_SCHEMA`)."""
    return files.select("path").mapInArrow(_members, MEMBER_SCHEMA)


def scan_members(files: DataFrame, tasks: int) -> DataFrame:
    """``path, block, problem`` of the listed archives, their members dealt to ``tasks`` tasks."""
    spread = list_members(files.repartition(tasks, "path")).repartition(tasks, "path", "start")
    return spread.mapInArrow(_inflate_members, "path string, block binary, problem string")


def scan_whole(files: DataFrame) -> DataFrame:
    """The same with each archive read whole by Spark, for stores only Spark can open.

    An archive is one task, and at most the 2 GiB that one binary value holds; beyond that Spark fails the job
    (``spark.sql.sources.binaryFile.maxLength``).
    """
    return files.select("path", "content").mapInArrow(inflate, "path string, block binary, problem string")


def member_tasks(spark: SparkSession, files: DataFrame) -> int:
    """One task for each 128 MB of archives and at least one a core, from the listing."""
    total = files.agg(F.sum("length")).first()[0] or 0
    return max(-(-total // TASK_BYTES), spark.sparkContext.defaultParallelism)


def scheme_of(spark: SparkSession, root: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getScheme()


def below(path: Column, root: str, spark: SparkSession) -> Column:
    """The part of a listed file's path below ``root``, which is cut off once, at the front."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getPath()
    start = whole.rstrip("/") + "/"
    local = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(local.startswith(start), F.substring(local, len(start) + 1, 1 << 30)).otherwise(local)


def scan_archives(
    spark: SparkSession, root: str, prefix: str, ranged: bool | None = None, files: DataFrame | None = None
) -> DataFrame:
    """``source_path, block, problem`` of every archive below ``root/prefix``, or of the listed ``files``.

    ``ranged``: tasks open the store themselves and share an archive's members; by default where it is one of
    :data:`RANGED_STORES`. Otherwise Spark reads each archive whole.
    """
    files = list_files(spark, f"{root.rstrip('/')}/{prefix}") if files is None else files
    if ranged is None:
        ranged = scheme_of(spark, root) in RANGED_STORES
    blocks = scan_members(files, member_tasks(spark, files)) if ranged else scan_whole(files)
    return placed(blocks, spark, root)


def placed(blocks: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    return blocks.select(below(F.col("path"), root, spark).alias("source_path"), "block", "problem")


def parse_lines(blocks: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """One row per non-blank line: ``numbers`` as doubles, ``texts`` as they are, and in ``BAD_LINE`` a line
    that is no JSON object.

    Numbers are read as such by the JSON reader. Only a line where one is written as text, or is no number
    at all, is read a second time as text and parsed permissively. Columns beside ``block`` are kept;
    whatever they hold was computed once per block, not per line.
    """
    carried = [c for c in blocks.columns if c != "block"]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}

    def record(line: Column, number: str) -> Column:
        fields = [f"`{n}` {number}" for n in numbers] + [f"`{t}` string" for t in [*texts, BAD_LINE]]
        return F.from_json(line, ", ".join(fields), options)

    lines = F.filter(F.split(F.col("block").cast("string"), "\n"), lambda line: line.rlike(r"\S"))
    if "problem" in carried:  # an unreadable archive is one bad line
        lines = F.when(F.col("problem").isNotNull(), F.array(F.lit("(archive)"))).otherwise(lines)
    # One generator for lines and records: Spark copies neither into the columns that use them.
    parsed = F.transform(lines, lambda line: F.struct(line.alias("line"), record(line, "double").alias("typed")))
    rows = blocks.select(*carried, F.explode(parsed).alias("_r")).select(*carried, "_r.line", "_r.typed")
    line, typed = F.col("line"), F.col("typed")
    smooth = typed[BAD_LINE].isNull()
    plain = record(line, "string")  # read for the lines that are not smooth only
    # Read as text, an unquoted NaN or Infinity comes back in quotes.
    unquote = lambda text: F.regexp_replace(text, '^"(-?[A-Za-z]+)"$', "$1")
    well_formed = line.rlike(r"^\s*\{") & F.is_valid_utf8(line)
    return rows.select(
        *carried,
        *[F.when(smooth, typed[n]).otherwise(permissive_double(unquote(plain[n]))).alias(n) for n in numbers],
        *[typed[t].alias(t) for t in texts],
        F.when(~well_formed, line).when(~smooth, plain[BAD_LINE]).alias(BAD_LINE),
    )
