"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced together.

Equal texts form a group. A heavy group is an item of its own, cut into pieces where it exceeds a shard; light groups
are bundled by hash into a fixed number of items. So the packing itself sees a bounded list, whatever the table holds,
and each item goes where the dot product of its vector with the residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import kept, numbered

SIZES = ["size", "tokens", "rows"]
BUNDLES = 256  # of light groups, per shard
HEAVY = 1024  # a group is heavy beyond this fraction of a shard


def packed(items: np.ndarray, shards: int, weights: tuple[float, ...] = (64.0, 1.0, 1.0)) -> np.ndarray:
    """The shard of each item (rows of shares of the totals, largest first placed).

    Capacity is one shard's even share of each dimension. Of the shards with the highest dot product of item and
    residual capacity the first one is taken; ``weights`` states how much each dimension counts.
    """
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    scale = np.array(weights[: items.shape[1]])
    out = np.zeros(len(items), np.int32)
    for k in np.lexsort((np.arange(len(items)), -(items * scale).sum(1))):
        out[k] = int(np.argmax(residual @ (items[k] * scale)))
        residual[out[k]] -= items[k]
    return out


def sharded(docs: DataFrame, shards: int = 24, bundles: int = BUNDLES, heavy: int = HEAVY) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``: one row per row of ``docs``.

    The law is ``bytes``: shards are near equal in bytes (UTF-8 text plus 8 a row), and as equal in words and rows
    as that allows. Rows of equal text stay together unless the group is larger than a shard in some dimension;
    then it is cut into equal pieces. ``slot`` counts a shard's rows by (doc_id, text) from 0. A null text is empty; a
    null doc_id comes first; repeated rows get slots of their own. ``grown_shard`` is null under this law. Other
    columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.sha2(text, 256).alias("of"),
    )
    rows = kept(rows, "sizes")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        total = {"size": 1, "tokens": 1, "rows": 1}
    whole = [max(total[s], 1) for s in SIZES]
    share = F.greatest(*[F.col(s) / F.lit(float(w)) for s, w in zip(SIZES, whole, strict=True)])
    # At most 3 * heavy * shards groups can exceed this share: a bounded table.
    large = rows.groupBy("of").agg(*sums).withColumn("share", share).where(F.col("share") * heavy * shards > 1)
    pieces = F.ceil(F.col("share") * shards).cast("long")
    large = kept(large.select(F.col("of").alias("_of"), pieces.alias("pieces")), "heavy")
    marked = rows.join(F.broadcast(large), F.col("of") == F.col("_of"), "left")
    spread = F.pmod(F.xxhash64("doc_id"), F.col("pieces"))
    item = F.when(F.col("pieces").isNull(), F.concat(F.lit("light "), F.pmod(F.xxhash64("of"), F.lit(bundles * shards))))
    marked = marked.withColumn("item", F.coalesce(item, F.concat_ws(" ", "of", spread)))
    listed = marked.groupBy("item").agg(*sums).orderBy("item").toPandas()  # bounded as said above
    where = packed(listed[SIZES].to_numpy(float) / np.array(whole, float), shards)
    pairs = [(str(i), int(s)) for i, s in zip(listed["item"], where, strict=True)]
    placed = docs.sparkSession.createDataFrame(pairs, "item string, shard int")
    out = marked.join(F.broadcast(placed), "item").select("doc_id", "size", "text_crc32", "shard", "of")
    out = numbered(out, ["shard"], ["doc_id", "of"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
