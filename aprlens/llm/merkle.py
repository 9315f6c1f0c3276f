"""Merkle manifest of a dataset as a postorder append log.

A forest has one tree per source over the leaves in order; every three consecutive nodes of a level become one node above,
the last run of a level may be shorter. Subroots are the leaves of one more tree.

Leaves are numbered in a range-partitioned pass. An aligned block of 3^7 leaves is a whole subtree, so builders work apart:
each writes its block's nodes in the order in which they are completed (postorder) and appends them as one segment of the
log; the blocks' roots are the leaves of the next tier. Where a node lies in a segment, or in the log of a whole tree,
follows from the sizes of the subtrees completed before it, so proofs read siblings by their address, block by block, from
the top tier down. A tree of 10^12 leaves has four tiers; no task ever holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import INDEX_BITS, kept

ARITY = 3
HEIGHT = 7  # of a block
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "struct<left: string, right: string>"

_SEGMENT = "tree string, block long, leaves long, alone boolean, nodes array<string>, members array<long>, notes array<string>"
_PROOF = f"tree string, at long, member long, note string, leaf string, subroot string, steps array<{STEP}>"


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Lower-case hex SHA-256 over the fields of a row."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in LEAF_FIELDS]), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and the siblings of its proof give."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 over all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def level_counts(leaves: int, height: int | None = None) -> list[int]:
    """Nodes of each level; up to the single root, or up to ``height``."""
    counts = [leaves]
    while counts[-1] > 1 if height is None else len(counts) <= height:
        counts.append(-(-counts[-1] // ARITY))
    return counts


def addresses(counts: list[int], level: int, index: np.ndarray) -> np.ndarray:
    """Postorder positions, from 0, of the nodes ``index`` of a level.

    Before a node is done, so are all levels below it up to its last descendant, and of each level above the nodes that
    lie wholly to its left.
    """
    place = np.full(len(index), -1, np.int64)
    for other, n in enumerate(counts):
        if other <= level:
            place += np.minimum((index + 1) * ARITY ** (level - other), n)
        else:
            place += index // ARITY ** (other - level)
    return place


@lru_cache(maxsize=64)
def _addresses(leaves: int, height: int | None) -> list[np.ndarray]:
    counts = level_counts(leaves, height)
    return [addresses(counts, level, np.arange(n)) for level, n in enumerate(counts)]


def completed(leaves: list[str], height: int | None) -> list[str]:
    """All nodes over ``leaves`` in the order of completion."""
    at = _addresses(len(leaves), height)
    log, level = [""] * sum(map(len, at)), leaves
    for places in at:
        if places is not at[0]:
            level = [
                hashlib.sha256("".join(level[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(level), ARITY)
            ]
        for place, node in zip(places.tolist(), level, strict=True):
            log[place] = node
    return log


def siblings(nodes: list[str], leaves: int, height: int | None) -> list[list[tuple[str, str]]]:
    """Per level below the root, for each node: the siblings before it and after it."""
    out = []
    for places in _addresses(leaves, height)[:-1]:
        level = [nodes[p] for p in places.tolist()]
        sides = []
        for first in range(0, len(level), ARITY):
            run = level[first : first + ARITY]
            sides += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
        out.append(sides)
    return out


def _builder(height: int):
    """One segment per block. A tree's only block ends at its root, others at the full height, so that blocks align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = batch.slice(row, 1)
                nodes = completed(held["digest"][0].as_py(), None if held["alone"][0].as_py() else height)
                names = ["tree", "block", "leaves", "alone", "nodes", "members", "notes"]
                columns = [pa.array([nodes], pa.list_(pa.string())) if c == "nodes" else held[c] for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _prover(height: int):
    """The proof of every leaf of a block: its siblings inside the block, then those above the block."""

    def proved(held: pa.RecordBatch) -> pa.RecordBatch:
        tree, block, alone, nodes, above, subroot = (
            held[c][0].as_py() for c in ("tree", "block", "alone", "nodes", "above", "subroot")
        )
        members, notes = (held[c].flatten() for c in ("members", "notes"))
        n, own = len(members), None if alone else height
        inside, places = siblings(nodes, n, own), _addresses(n, own)[0].tolist()
        high = [(s["left"], s["right"]) for s in above]
        sides = [s for i in range(n) for s in [*(level[i // ARITY**k] for k, level in enumerate(inside)), *high]]
        depth = len(inside) + len(high)
        # Built flat: no Python object per step and row.
        left, right = (pa.array([s[side] for s in sides], pa.string()) for side in (0, 1))
        steps = pa.StructArray.from_arrays([left, right], ["left", "right"])
        steps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * depth, pa.int32()), steps)
        first = block * ARITY**height
        columns = [
            pa.array([tree] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), members, notes,
            pa.array([nodes[p] for p in places], pa.string()), pa.array([subroot or nodes[-1]] * n, pa.string()), steps,
        ]
        return pa.RecordBatch.from_arrays(columns, ["tree", "at", "member", "note", "leaf", "subroot", "steps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield proved(batch.slice(row, 1))

    return run


class Forest(NamedTuple):
    """``tiers``: the segments of the log, lowest first; ``roots``: ``tree, leaves, digest`` of every tree; ``height``: of
    a block."""

    tiers: list[DataFrame]
    roots: DataFrame
    height: int


def grown(leaves: DataFrame, height: int = HEIGHT) -> Forest:
    """The trees over ``leaves``: ``tree`` (null is a tree too), ``at`` (gapless from 0 in a tree), ``leaves`` (of the whole
    tree), ``digest``, and ``member`` and ``note``, which go along with a leaf."""
    size, nodes, tiers = ARITY**height, leaves, []
    while True:
        entry = F.struct("at", "digest", "member", "note")
        blocks = nodes.groupBy("tree", F.expr(f"at div {size}").alias("block")).agg(
            F.first("leaves").alias("leaves"),
            F.array_sort(F.collect_list(entry)).alias("run"),  # one block at most
        )
        alone = (F.col("leaves") <= size ** (len(tiers) + 1)).alias("alone")
        lists = [F.col(f"run.{c}").alias(name) for c, name in (("digest", "digest"), ("member", "members"), ("note", "notes"))]
        segments = blocks.select("tree", "block", "leaves", alone, *lists)
        segments = segments.mapInArrow(_builder(height), _SEGMENT)
        tiers.append(kept(segments, f"merkle-tier-{len(tiers)}"))
        tops = tiers[-1].select(
            "tree", F.col("block").alias("at"), "leaves", "alone", F.element_at("nodes", -1).alias("digest"),
            F.col("block").alias("member"), F.lit(None).cast("string").alias("note"),
        )
        nodes = tops.where("not alone").drop("alone")
        if nodes.isEmpty():
            break
    ended = [t.where("alone").select("tree", "leaves", F.element_at("nodes", -1).alias("digest")) for t in tiers]
    return Forest(tiers, kept(reduce(DataFrame.unionByName, ended), "merkle-roots"), height)


def proofs(forest: Forest, above: DataFrame) -> DataFrame:
    """``tree, at, member, note, leaf, subroot, steps`` of every leaf. ``above``: ``tree, leaves, steps``, the steps that
    follow those inside a tree.

    Steps go from the leaf up; each holds the siblings before and after the node, joined.
    """
    size, found = ARITY**forest.height, None
    for k in reversed(range(len(forest.tiers))):
        ending = (F.col("leaves") <= size ** (k + 1)) & (F.col("leaves") > (size**k if k else 0))
        high = above.where(ending).select(
            F.col("tree").alias("_of"), F.lit(0).cast("long").alias("_block"), F.lit(None).cast("string").alias("subroot"),
            F.col("steps").alias("above"),
        )
        if found is not None:
            inner = found.select(F.col("tree").alias("_of"), F.col("at").alias("_block"), "subroot", F.col("steps").alias("above"))
            high = high.unionByName(inner)
        # Keyed by block, so a tree that holds most leaves is spread.
        met = forest.tiers[k].join(high, F.col("tree").eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_block")))
        found = met.drop("_of", "_block", "leaves").mapInArrow(_prover(forest.height), _PROOF)
        if k:
            found = kept(found, "merkle-proofs")
    return found


def _log_of(tier: int, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, leaves, alone, nodes, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts, place, digest = level_counts(leaves), [], []
                for level, local in enumerate(_addresses(held, None if alone else height)):
                    if level or not tier:  # a higher tier's leaves are the roots below it
                        index = np.arange(len(local)) + (0 if alone else block * ARITY ** (height - level))
                        place += addresses(counts, tier * height + level, index).tolist()
                        digest += [nodes[p] for p in local.tolist()]
                columns = [pa.array([tree] * len(place), pa.string()), pa.array(place, pa.int64()), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "position", "digest"])

    return run


def postorder_log(forest: Forest) -> DataFrame:
    """``tree, position, digest`` of every node: position in the order in which a single builder would complete the tree."""
    columns = ["tree", "block", "leaves", "alone", "nodes", F.size("members").alias("held")]
    parts = [t.select(*columns).mapInArrow(_log_of(k, forest.height), "tree string, position long, digest string") for k, t in enumerate(forest.tiers)]
    return reduce(DataFrame.unionByName, parts)


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the gapless 0-based place within ``tree`` by ``order``, and ``leaves``, the rows of the tree.

    Rows are dealt by range, so a tree of any size is spread over tasks; only the count of each (tree, partition) meets
    elsewhere. Rows that are equal in ``order`` may change places.
    """
    keys = ["tree", *order]
    rows = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = kept(rows, "merkle-leaves").withColumn("_part", F.shiftrightunsigned("_at", INDEX_BITS))
    runs = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per tree and partition: a tree has as many as it has partitions.
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    runs = runs.select(
        F.col("tree").alias("_tree"), F.col("_part").alias("_run"), shift.alias("_shift"), F.sum("_n").over(whole).alias("leaves")
    )
    same = (F.col("_part") == F.col("_run")) & F.col("tree").eqNullSafe(F.col("_tree"))
    return rows.join(runs, same).select(*leaves.columns, (F.col("_at") + F.col("_shift")).alias("at"), "leaves")


class Manifest(NamedTuple):
    """``forest``: a tree per source; ``top``: the tree over the subroots, whose own tree is null; ``sources``: the place
    of every source's subroot in it; ``root``: null where there is no row."""

    forest: Forest
    top: Forest
    sources: DataFrame
    root: str | None

    def proofs(self) -> DataFrame:
        """``tree`` (the source), ``at``, ``member``, ``note``, ``leaf``, ``subroot``, ``root`` and ``steps`` of every row."""
        nothing = F.array().cast(f"array<{STEP}>").alias("steps")
        over = proofs(self.top, self.top.roots.select("tree", "leaves", nothing)).select("at", "steps")
        own = self.forest.roots.select(F.col("tree").alias("_tree"), "leaves")
        over = self.sources.select("tree", "at").join(over, "at").join(own, F.col("tree").eqNullSafe(F.col("_tree")))
        found = proofs(self.forest, kept(over.select("tree", "leaves", "steps"), "merkle-top"))
        return found.withColumn("root", F.lit(self.root).cast("string"))


def manifest(docs: DataFrame, note: Column | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of ``docs`` (:data:`LEAF_FIELDS`): leaves per source by ``doc_id``, null first. ``note``, a text, goes
    along with a leaf into its proof.

    Any field may be null. Rows with the same id go by their digest; equal rows are leaves of their own. Texts of any
    length are hashed whole. An empty table has no root. Other columns are ignored.
    """
    note = (F.lit(None) if note is None else note).cast("string")
    rows = docs.select(
        F.col("source").alias("tree"), F.col("doc_id").alias("member"), leaf_digest().alias("digest"), note.alias("note")
    )
    forest = grown(placed(rows, ["member", "digest"]), height)
    none = F.lit(None).cast("string")
    subroots = forest.roots.select(none.alias("tree"), F.col("tree").alias("source"), "digest")
    subroots = kept(placed(subroots, ["source"]), "merkle-subroots")
    top = grown(subroots.select("tree", "at", "leaves", "digest", F.col("at").alias("member"), none.alias("note")), height)
    root = top.roots.first()
    sources = subroots.select(F.col("source").alias("tree"), "at", "digest")
    return Manifest(forest, top, sources, root["digest"] if root else None)


def tampered_text() -> Column:
    """The text without line breaks where 2 divides crc32 of the id; a null id is left alone."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))


def verified(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per row: ``leaf``, ``subroot``, ``root`` and ``proof_sha256`` of the untampered table, ``folded_root`` from the
    tampered leaf and the original siblings, and whether it equals the root."""
    found = manifest(docs, leaf_digest(text=tampered_text()), height).proofs()
    return found.select(
        F.col("member").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
        folded(F.col("note"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
