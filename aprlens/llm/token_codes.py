"""Token-id files in directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one, a bitmap that
tells which of its ids go on, and a rank directory over that bitmap; so any id is found by one rank per level, without
decoding what lies before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import encoder
from .files import write_file
from .shared import kept, scratch
from .words import text_parts

MAGIC = b"DAC1"
SPAN = 512  # bits between entries of a rank directory
FILE_TOKENS = 1 << 22  # ids in a file; a longer document has a file of its own
END = b"\0\0\0\0"  # the end-of-document id 0


def encoded(ids: np.ndarray, ends: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """One file: header, document ends and ids, then each level's chunks, bitmap and rank directory."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), SPAN)) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
        levels.append((rest.astype(np.uint8), bits, ranks.astype("<u4")))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [MAGIC, struct.pack("<IQQ", len(levels), len(ids), len(ends)), ends.astype("<u8").tobytes()]
    parts += [names.tobytes(), known.tobytes()]
    for chunk, bits, ranks in levels:
        parts += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class TokenFile:
    """Random access to one file's ids."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a token file")
        levels, self.n_tokens, self.n_docs = struct.unpack_from("<IQQ", content, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        self.ends = take("<u8", self.n_docs).astype(np.int64)
        names, known = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known, strict=True)]
        self.levels = []
        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", -(-n // SPAN))))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before position ``i``: a directory entry and at most ``SPAN`` bits."""
        block = min(i // SPAN, len(ranks) - 1) if len(ranks) else 0
        if not len(ranks):
            return 0
        inside = np.unpackbits(bits[block * SPAN // 8 : -(-i // 8)], bitorder="little")[: i - block * SPAN]
        return int(ranks[block]) + int(inside.sum())

    def token(self, i: int) -> int:
        value = shift = 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (exclusive)."""
        return self._range(0, start, stop)

    def _range(self, level: int, start: int, stop: int) -> np.ndarray:
        chunk, bits, ranks = self.levels[level]
        out = chunk[start:stop].astype(np.uint32)
        if level + 1 < len(self.levels) and stop > start:
            low = start // 8
            more = np.unpackbits(bits[low : -(-stop // 8)], bitorder="little")[start - low * 8 : stop - low * 8]
            more = more.astype(bool)
            first = self._rank(bits, ranks, start)
            out[more] |= self._range(level + 1, first, first + int(more.sum())) << np.uint32(8)
        return out


def _writer(vocabulary: str, folder: str, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        ids, names, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, names, held, count
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            content = encoded(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes), names)
            file = write_file(folder, f"part-{part:06d}-{count:06d}.dac", content)
            row = {"file": [file], "part": [part], "place": [count], "docs": [len(ids)], "tokens": [int(sizes.sum())]}
            ids, names, held, count = [], [], 0, count + 1
            return pa.RecordBatch.from_pydict(row)

        encode = encoder(vocabulary).encode
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for cut, texts in text_parts(batch.column("text")):
                for doc_id, x in zip(doc_ids[cut], encode(texts), strict=True):
                    own = len(x) // 4 + 1
                    if ids and held + own > file_tokens:
                        yield flush()
                    ids.append(x + END)
                    names.append(doc_id)
                    held += own
        if ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the ids of all texts in ascending doc_id order (null first, ties by text) and returns the manifest:
    ``file``, ``part``, ``place``, ``docs``, ``tokens``, and ``start``, the ids in all files before.

    Null and empty texts have the end id only. Order comes from a range partitioning, so any number of documents is
    spread over tasks.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = texts.repartitionByRange("doc_id", F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    files = ordered.mapInArrow(
        _writer(vocabulary, folder, file_tokens), "file string, part long, place long, docs long, tokens long"
    )
    files = kept(files, "manifest")
    totals = files.groupBy("part").agg(F.sum("tokens").alias("sum"))  # a row per task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return files.join(totals, "part").withColumn("start", start).drop("ahead")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            file = TokenFile(content)
            starts = np.concatenate([[0], file.ends[:-1]]).astype(np.int64)
            sums = [zlib.crc32(file.tokens(s, e).astype("<u4")) for s, e in zip(starts, file.ends, strict=True)]
            n = len(sums)
            columns = [
                pa.array([path.rsplit("/", 1)[-1]] * n, pa.string()),
                pa.array(file.doc_ids, pa.int64()),
                pa.array(starts),
                pa.array(file.ends - starts),
                pa.array(sums, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "offset", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``file``, ``doc_id``, ``offset`` in the file, ``n_tokens``, ``ids_crc32``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.dac").load(folder)
    schema = "file string, doc_id long, offset long, n_tokens long, ids_crc32 long"
    return files.select("path", "content").mapInArrow(_reader, schema)


def token_table(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Writes the token files, reads them back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` per document.

    Repeated rows are documents of their own, in a fixed order. Other columns are ignored; an empty table gives no
    files and an empty result.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    files = write_tokens(docs, vocabulary, folder)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    read = read_tokens(spark, folder).join(files.select("file", F.col("start").alias("ahead")), "file")
    return read.select("doc_id", (F.col("ahead") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
