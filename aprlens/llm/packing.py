"""Packing into optimal length buckets.

The global length histogram is at most as long as the longest sequence. Dynamic programming over it chooses the bucket
bounds that minimise padding, and token-budget batches form inside each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import encoder
from .shared import kept, numbered
from .words import text_parts

MAX_LENGTH, BUCKETS, BUDGET = 2048, 12, 65_536


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` ascending bounds, the last one the greatest length, with the least sum of
    (bound - length) over all sequences."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    upto = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])]).astype(np.int64)
    m = len(lengths)
    never = np.iinfo(np.int64).max // 4
    best, choices = np.full(m + 1, never), []
    best[0] = 0
    later = np.tri(m, m + 1, 0, dtype=bool)  # bucket i + 1 .. j ends at length j, i <= j - 1
    for _ in range(min(buckets, m)):
        cost = np.where(later, best[None, :] - lengths[:, None] * upto[None, :], never)
        pick = cost.argmin(1)
        total = np.minimum(cost[np.arange(m), pick] + lengths * upto[1:], never)
        choices.append(pick)
        best = np.concatenate([[never], total])
    j, bounds = m - 1, []
    for pick in reversed(choices):
        bounds.append(int(lengths[j]))
        j = int(pick[j]) - 1
        if j < 0:
            break
    return bounds[::-1]


def _lengths(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            n = []
            for _, texts in text_parts(batch.column("text")):
                n += [len(x) // 4 + 1 for x in encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return run


def packed_batches(
    docs: DataFrame, vocabulary: str, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """``doc_id``, ``part``, ``start``, ``n_tokens``, ``bucket``, ``bucket_length``, ``batch``, ``place``.

    A document has its byte-level BPE ids and an end id. A document longer than ``max_length`` is cut into full
    sequences and a last one, so each of its tokens is packed once. ``bucket`` numbers the length buckets from 0;
    sequences of a bucket are dealt by (doc_id, start) into ``batch`` 0, 1, ... of as many as fit ``budget`` when
    padded to ``bucket_length``, one at least; ``place`` is the position in the batch. Null and empty texts have the
    end id only, a null doc_id comes first, repeated rows are packed each. Other columns are ignored; an empty table
    gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    lengths = docs.select("doc_id", "text").mapInArrow(_lengths(vocabulary), f"doc_id {kind}, tokens long")
    lengths = kept(lengths, "lengths")
    last = F.floor((F.col("tokens") - 1) / max_length)
    parts = lengths.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    parts = parts.withColumn("start", F.col("part") * max_length)
    parts = parts.withColumn("n_tokens", F.least(F.lit(max_length), F.col("tokens") - F.col("start"))).drop("tokens")
    # At most ``max_length`` rows.
    histogram = {r["n_tokens"]: r["n"] for r in parts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = bucket_bounds(histogram, buckets) or [max_length]
    place = F.array_position(F.transform(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("n_tokens")), True)
    parts = parts.withColumn("bucket", place.cast("int") - 1)
    parts = parts.withColumn("bucket_length", F.get(F.array(*map(F.lit, bounds)), F.col("bucket")))
    parts = numbered(parts, ["bucket"], ["doc_id", "start"])
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length")))
    return parts.select(
        "doc_id",
        "part",
        "start",
        "n_tokens",
        "bucket",
        "bucket_length",
        F.floor(F.col("slot") / fits).alias("batch"),
        (F.col("slot") % fits).alias("place"),
    )
