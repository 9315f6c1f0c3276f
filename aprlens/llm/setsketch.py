"""MinHash near-dedup by SetSketch registers.

A register is the level of the smallest of exponentially spaced hash values of a shingle set, cut to a fixed range.
Registers of a union are the larger of both (:func:`merged`); two sets agree in a register about as often as they
share elements. Documents that agree in one band of registers become candidates, the joint likelihood of their
register order estimates the Jaccard similarity, and full shingle sets confirm a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import release
from .shared import components, kept, least_roots
from .words import LOWER, Scan, mixed, text_parts

WIDTH = 5  # words in a shingle
BANDS, ROWS = 48, 5  # a pair at 0.75 meets in no band with probability (1 - 0.75 ** 5) ** 48, about 2e-6
SPACING, RATE, TOP = 1.001, 20.0, 65_534  # base of the levels, rate of the exponential, highest level below the cut
SLACK = 18.0  # log-likelihood by which an estimate may fall short before a candidate is left unverified

_rng = np.random.default_rng(20_211)
_FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def levels(least: np.ndarray) -> np.ndarray:
    """Registers from the least 64-bit hash per register: floor(1 - log_b(x)) of x ~ Exp(RATE), cut to 0..TOP + 1."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(SPACING)), 0, TOP + 1).astype("<u2")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of one non-empty set of 64-bit hashes, in bounded memory whatever its size."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * _FACTORS + _SHIFTS
        part ^= part >> np.uint64(32)
        np.minimum(least, part.min(axis=0), out=least)
    return levels(least)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: windows of :data:`WIDTH` words, the whole sequence of a
    shorter text, nothing for a text without words."""
    scan = Scan([None if t is None else t.encode() for t in texts], LOWER)
    n = np.bincount(scan.doc, minlength=scan.count)
    keys, doc = scan.windows(WIDTH)
    ends = np.searchsorted(doc, np.arange(scan.count + 1))
    first = np.concatenate([[0], np.cumsum(n)])
    out = []
    for i in range(scan.count):
        if n[i] >= WIDTH:
            out.append(np.unique(keys[ends[i] : ends[i + 1]]))
        elif n[i]:
            own = mixed(np.array([n[i]], np.uint64))
            for h in scan.hash[first[i] : first[i + 1]]:
                own = mixed(own * np.uint64(31) + h)
            out.append(own)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _batched(emit):
    """An Arrow task that hands bounded runs of texts to ``emit`` and appends its arrays to the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            other = [n for n in batch.schema.names if n != "_text"]
            for part, texts in text_parts(batch.column("_text")):
                kept_rows = batch.slice(part.start, part.stop - part.start)
                extra = emit(shingle_sets(texts))
                yield pa.RecordBatch.from_arrays(
                    [*[kept_rows.column(n) for n in other], *extra.values()], [*other, *extra]
                )

    return run


def _signatures(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    return {
        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
        "print": pa.array([_fingerprint(s) for s in sets], pa.binary()),
        "registers": pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
    }


def _full_sets(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    return {
        "print": pa.array([_fingerprint(s) for s in sets], pa.binary()),
        "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
    }


def _share(x: np.ndarray) -> np.ndarray:
    """p_b(x) = -log_b(1 - x (b - 1) / b), the chance that one set's register is the higher."""
    return -np.log1p(-np.maximum(x, 0) * (SPACING - 1) / SPACING) / np.log(SPACING)


def log_likelihood(j: np.ndarray, u: np.ndarray, higher: np.ndarray, lower: np.ndarray, same: np.ndarray):
    """Of Jaccard similarity ``j`` given how many registers of the first set are higher, lower, equal; ``u`` is the
    first set's share of the summed sizes."""
    v = 1 - u
    up, down = _share(u - v * j), _share(v - u * j)
    tiny = 1e-12
    rest = np.maximum(1 - up - down, tiny)
    return higher * np.log(np.maximum(up, tiny)) + lower * np.log(np.maximum(down, tiny)) + same * np.log(rest)


def estimate(na: np.ndarray, nb: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most likely Jaccard similarity of pairs of sketches, and the sketch-register counts' likelihood there."""
    higher, lower = (ra > rb).sum(1), (ra < rb).sum(1)
    same = ra.shape[1] - higher - lower
    u = na / (na + nb)
    low, high = np.zeros(len(na)), np.minimum(na, nb) / np.maximum(na, nb)
    value = lambda j: log_likelihood(j, u, higher, lower, same)
    for _ in range(40):  # ternary search: the likelihood is concave in j
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = value(a) > value(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    best = (low + high) / 2
    return best, value(best)


def _plausible(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            ra, rb = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(len(na), -1)
                for c in ("registers_a", "registers_b")
            )
            best, peak = estimate(na, nb, ra, rb)
            higher, lower = (ra > rb).sum(1), (ra < rb).sum(1)
            most = np.minimum(na, nb) / np.maximum(na, nb)
            at = np.minimum(similarity, most)
            there = log_likelihood(at, na / (na + nb), higher, lower, ra.shape[1] - higher - lower)
            keep = (most >= similarity) & ((best >= similarity) | (peak - there <= SLACK))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"]
            )

    return run


def near_duplicates(
    docs: DataFrame, similarity: int = 75, carried: list[str] | None = None, small_bucket: int = 32, block: int = 512
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``head``: one row per row of ``docs``, with the columns
    named in ``carried``.

    Two rows are linked when 100 x shared shingles >= ``similarity`` x all their shingles. ``component_id`` is the
    smallest ``doc_id`` reachable by links; a row is kept if that is its own. Texts without words (null, empty,
    blank) have an empty set, link with nothing and are kept. Rows with equal sets form one class, which only its
    first row represents, so thousands of copies cost one set. ``head`` marks one row of each component, the first by
    doc_id, also where doc_ids repeat. A repeated doc_id is a node per row. A null doc_id
    takes part in links, is never the smallest, and is kept only if nothing else is in its component. Other columns
    are ignored; an empty table gives an empty result. ``small_bucket`` and ``block`` change the work, never the
    result.
    """
    carried = carried or []
    source = docs.select("doc_id", *carried, F.col("text").alias("_text"))
    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ["doc_id", *carried])
    rows = source.mapInArrow(_batched(_signatures), f"{fields}, n_shingles long, print binary, registers binary")
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "signatures")
    filled = rows.where("n_shingles > 0")
    least = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    classes = filled.groupBy("print").agg(F.min(least).alias("least"))
    classes = kept(
        classes.select("print", F.col("least.doc_id").alias("first_id"), F.col("least.row").alias("node")), "classes"
    )
    heads = rows.join(classes.select("node"), F.col("row") == F.col("node"), "left_semi")
    heads = heads.select(F.col("row").alias("node"), "doc_id", "n_shingles", "print", "registers")
    size = 2 * ROWS
    bands = heads.select(
        "node",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda i: F.xxhash64(i, F.substring("registers", i * size + 1, F.lit(size))),
            )
        ).alias("band"),
    )
    # First pass: every class against the least one of each of its buckets.
    members = kept(_unsettled(bands.withColumn("of", F.col("node"))), "members")
    pairs = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = kept(pairs, "pairs")
    likely, sets = _likely(source, heads, pairs, similarity)
    linked = kept(components(kept(_confirmed(likely, sets, similarity), "links")), "linked")
    # Second pass: what a bucket still holds of unlinked classes. A small one lists its pairs; large ones that overlap
    # form a cluster, whose sets are compared block by block, and only links leave a task.
    of = members.join(linked, F.col("node") == F.col("id"), "left")
    of = of.select("band", "node", F.coalesce("component", "node").alias("of"))
    members = _unsettled(of).select("band", "node", "of", "hub", "size")
    members = kept(members, "unsettled")
    small = members.where(F.col("size") <= small_bucket)
    more = small.select("band", F.col("node").alias("a"), F.col("of").alias("of_a"))
    more = more.join(small.select("band", F.col("node").alias("b"), F.col("of").alias("of_b")), "band")
    more = more.where("a < b and of_a <> of_b").select("a", "b").distinct()
    more = kept(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    large = members.where(F.col("size") > small_bucket)
    cluster = kept(components(large.select(F.col("hub").alias("a"), F.col("node").alias("b"))), "clusters")
    likely, sets = _likely(source, heads, more, similarity, sets, cluster.select(F.col("id").alias("node")))
    found = kept(
        _confirmed(likely, sets, similarity).unionByName(_within(cluster, large, sets, similarity, block)), "links"
    )
    if not found.isEmpty():
        earlier = linked.select(F.col("id").alias("a"), F.col("component").alias("b"))
        linked = kept(components(found.unionByName(earlier)), "linked")
    return _with_components(rows, classes, linked, carried)


def _unsettled(members: DataFrame) -> DataFrame:
    """The rows (band, node, of) of buckets whose nodes are in more than one component ``of``, with the bucket's
    ``size`` and least node ``hub``."""
    stats = members.groupBy("band").agg(
        F.min("of").alias("low"), F.max("of").alias("high"), F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")
    )
    return members.join(stats.where("low < high").select("band", "hub", "size"), "band")


def _linked_block(similarity: int):
    """Links between the classes of two blocks of a cluster, each class with the least one it reaches there."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if key[1] == key[2]:
            right = left  # a block with itself
        if left.empty or right.empty:  # of two blocks one may hold no class
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x, y = list(left["shingles"]), list(right["shingles"])
        nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
        common = np.intersect1d(np.concatenate(x), np.concatenate(y))
        shared = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, len(common), 8192):
            part = common[at : at + 8192]
            shared += _incidence(x, part) @ _incidence(y, part).T
        near = (100 + similarity) * shared.astype(np.int64) >= similarity * (nx[:, None] + ny[None, :])
        near &= left["of"].to_numpy()[:, None] != right["of"].to_numpy()[None, :]
        i, j = np.nonzero(near)
        a, b = left["node"].to_numpy(np.int64), right["node"].to_numpy(np.int64)
        root_a, root_b = least_roots(i, j, a, b)
        met_a, met_b = np.unique(i), np.unique(j)
        return pd.DataFrame(
            {"a": np.concatenate([a[met_a], b[met_b]]), "b": np.concatenate([root_a[met_a], root_b[met_b]])}
        )

    return run


def _incidence(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(part)), np.float32)
    for k, s in enumerate(sets):
        at = np.minimum(np.searchsorted(part, s), len(part) - 1)
        out[k, at[part[at] == s]] = 1
    return out


def _within(cluster: DataFrame, large: DataFrame, sets: DataFrame, similarity: int, block: int) -> DataFrame:
    """Links between unlike components of each cluster (id, component), by pairs of blocks of about ``block``."""
    # A block holds few classes and few shingles, so that long texts get smaller blocks.
    weights = cluster.join(sets.select("node", F.size("shingles").alias("n")), F.col("id") == F.col("node"))
    fill = F.greatest(F.count(F.lit(1)) / block, F.sum("n") / (block * 1000))
    size = weights.groupBy("component").agg(F.ceil(fill).cast("int").alias("blocks"))
    own = large.select("node", "of").distinct().join(cluster, F.col("node") == F.col("id"))
    own = own.join(size, "component").join(sets, "node")
    own = own.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    own = own.select("component", "node", "of", "shingles", "own", other)
    dealt = own.select(
        "component",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "node",
        "of",
        "shingles",
    )
    return dealt.groupBy("component", "i", "j").applyInPandas(_linked_block(similarity), "a long, b long")


def _likely(
    source: DataFrame,
    heads: DataFrame,
    pairs: DataFrame,
    similarity: int,
    sets: DataFrame | None = None,
    besides: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The pairs of class nodes that their sketches leave possible, and the shingle sets of all nodes in them and of
    the nodes ``besides``; ``sets`` has those already read."""

    def side(x: str) -> DataFrame:
        return heads.select(
            F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}")
        )

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    likely = kept(both.mapInArrow(_plausible(similarity / 100), "a long, b long"), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = (wanted if besides is None else wanted.unionByName(besides)).distinct()
    if sets is not None:
        wanted = wanted.join(sets.select("node"), "node", "left_anti")
    wanted = kept(heads.join(wanted, "node", "left_semi").select("node", "doc_id", "print"), "wanted")
    if wanted.isEmpty() and sets is not None:
        return likely, sets
    ids = wanted.select(F.col("doc_id").alias("_id"))
    texts = source.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    full = texts.select("_text").mapInArrow(_batched(_full_sets), "print binary, shingles array<long>")
    full = full.join(wanted.select("node", "print"), "print").select("node", "shingles")
    full = kept(full.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    return likely, full if sets is None else sets.unionByName(full)


def _confirmed(likely: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full shingle sets reach ``similarity`` per cent."""
    met = likely.join(sets.withColumnsRenamed({"node": "b", "shingles": "of_b"}), "b")
    met = met.join(sets.withColumnsRenamed({"node": "a", "shingles": "of_a"}), "a")
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    union = F.size("of_a") + F.size("of_b") - shared
    return met.where(100 * shared >= similarity * union).select("a", "b")


def _with_components(rows: DataFrame, classes: DataFrame, linked: DataFrame | None, carried: list[str]) -> DataFrame:
    named = classes.withColumn("of", F.col("node"))
    if linked is not None:
        named = classes.join(linked, F.col("node") == F.col("id"), "left")
        named = named.withColumn("of", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("first")
    least = named.groupBy("of").agg(first).select("of", F.col("first.first_id").alias("component_id"), F.col("first.node").alias("head_node"))
    of_class = named.join(least, "of").select(F.col("print").alias("_print"), "component_id", "head_node")
    out = rows.join(of_class, F.col("print") == F.col("_print"), "left")
    filled = F.col("n_shingles") > 0
    component = F.when(filled, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    head = (F.when(filled, F.col("row") == F.col("head_node")).otherwise(F.lit(True))).alias("head")
    out = out.select("doc_id", *carried, "n_shingles", component, head)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
