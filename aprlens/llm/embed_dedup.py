"""Embedding near-dedup: an exact metric range join on the unit sphere.

Pivots part the vectors of a label into cells by nearest pivot. A vector is also sent to every other cell that could
hold a vector within the radius, as far as the triangle inequality cannot exclude it, so each cell finds all links of
its own vectors by itself. A cell of any size is cut into blocks, and one task sees one pair of blocks.

A label of any size has pivots, two at least. More are taken for more vectors as long as a sample of the label says that
a vector is sent to few cells: where the triangle inequality excludes little, more cells would only mean more copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import components, kept, least_roots

BLOCK = 2048  # vectors of a cell compared at once with as many others
CELL = 1024  # vectors for which a label is offered one pivot more
MOST_COPIES = 2.5  # cells a vector is sent to on average, itself included; with two pivots they are at most two
SAMPLE = 64  # vectors of a label, at least, on which that is measured
MOST_PIVOTS = 16_384  # of all labels together: the bound of what is broadcast; more would only change the speed


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    cells = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles, null where a vector can link with nothing."""
    for batch in batches:
        out = []
        for v in batch.column("_vector").to_pylist():
            x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
            if x is None or not np.isfinite(x).all() or not x.any():
                out.append(None)
            else:  # scaled by a power of two, which is exact, so that no product overflows
                out.append(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).tobytes())
        at = batch.schema.get_field_index("_vector")
        yield batch.set_column(at, "vector", pa.array(out, pa.binary()))


def _reach(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and which cells it may have links in."""
    d2 = np.maximum(2 - 2 * (x @ p.T), 0)
    d, apart = np.sqrt(d2), np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
    own, row = d.argmin(1), np.arange(len(x))
    least = d[row, own][:, None]
    # Twice the radius is the general bound; the second is the distance to the plane between pivots.
    near = (d - least <= 2 * radius) & (d2 - least**2 <= 2 * radius * apart[own] + 1e-9)
    near[row, own] = True
    return own, near


def _enough(sample: np.ndarray, wanted: int, radius: float, most_copies: float) -> np.ndarray:
    """The first vectors of a label's sample as pivots: two, and twice as many up to ``wanted`` while copies stay few."""
    count = 2
    while 2 * count <= min(wanted, len(sample)) and _reach(sample, sample[: 2 * count], radius)[1].sum(1).mean() <= most_copies:
        count *= 2
    return sample[:count]


def _cells(pivots: dict, radius: float):
    """Each vector for its home cell, and for the other cells it may have links in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array([g if (g := str(x)) in pivots else "" for x in batch.column("space").to_pylist()])
            source, cell, home = [], [], []
            for group in np.unique(groups):
                at = np.flatnonzero(groups == group)
                if group == "":
                    source.append(at), cell.append(np.zeros(len(at), int)), home.append(np.ones(len(at), bool))
                    continue
                own, near = _reach(_unit(_matrix(batch.column("vector").take(pa.array(at)))), pivots[group], radius)
                i, c = np.nonzero(near)
                source.append(at[i]), cell.append(c), home.append(own[i] == c)
            take = pa.array(np.concatenate(source))
            rows = pa.RecordBatch.from_arrays([c.take(take) for c in batch.columns], names=batch.schema.names)
            rows = rows.append_column("cell", pa.array(np.concatenate(cell).astype(np.int32)))
            yield rows.append_column("home", pa.array(np.concatenate(home)))

    return run


def _links(threshold: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        own, other = block[block["own"]], block[~block["own"]]
        if own.empty or other.empty:
            return pd.DataFrame({"node": [], "root": [], "links": []}, dtype="int64")
        x, y = _matrix(own["vector"]), _matrix(other["vector"])
        norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        linked = (x @ y.T) / norms >= threshold
        a, b = own["node"].to_numpy(np.int64), other["node"].to_numpy(np.int64)
        linked &= a[:, None] != b[None, :]
        i, j = np.nonzero(linked)
        root_a, root_b = least_roots(i, j, a, b)
        weight = other["copies"].to_numpy(np.int64)
        links = np.bincount(i, weights=weight[j], minlength=len(a)).astype(np.int64)
        met = np.bincount(j, minlength=len(b)) > 0
        return pd.DataFrame(
            {
                "node": np.concatenate([a[links > 0], b[met]]),
                "root": np.concatenate([root_a[links > 0], root_b[met]]),
                "links": np.concatenate([links[links > 0], np.zeros(met.sum(), np.int64)]),
            }
        )

    return run


def range_join(
    vectors: DataFrame,
    threshold: float = 0.93,
    block: int = BLOCK,
    cell: int = CELL,
    most_pivots: int = MOST_PIVOTS,
    most_copies: float = MOST_COPIES,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept``: one row per row of ``vectors`` (vec_id, embedding, label).

    Rows of equal, non-null label are linked where their cosine reaches ``threshold``. Null vectors, zero vectors and
    vectors with a null or non-finite component link with nothing, nor do vectors of different lengths. Equal vectors
    of a label form one class that is compared once and counts with its number of rows; repeated rows are rows of
    their own. A null vec_id is never the smallest of a component. ``block``, ``cell``, ``most_pivots`` and ``most_copies``
    change the work, never the result. Labels beyond the ``most_pivots / 2`` largest are one cell each. Other columns are ignored; an empty table gives an empty result.
    """
    radius = float(np.sqrt(max(2 - 2 * threshold, 0))) + 1e-9
    rows = vectors.select("vec_id", F.col("embedding").alias("_vector"), F.col("label").alias("label"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    rows = rows.mapInArrow(_packed, ", ".join([fields[0], "vector binary", fields[2]]))
    space = F.concat_ws(":", F.octet_length("vector").cast("string"), F.col("label").cast("string"))
    usable = F.col("vector").isNotNull() & F.col("label").isNotNull()
    rows = kept(
        rows.select(
            "vec_id",
            F.when(usable, F.col("vector")).alias("vector"),
            F.when(usable, space).alias("space"),
            F.when(usable, F.sha2(F.concat(space.cast("binary"), "vector"), 256)).alias("print"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "vectors",
    )
    least = F.struct(F.col("vec_id").isNull(), "vec_id", "row")
    classes = rows.where("print is not null").groupBy("print", "space")
    classes = classes.agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select(
        "print", "space", "copies", F.col("least.vec_id").alias("first_id"), F.col("least.row").alias("node")
    )
    classes = kept(classes, "classes")
    heads = rows.select("row", "vector").join(classes.select("node", "space", "copies"), F.col("row") == F.col("node"))
    heads = heads.select("node", "space", "copies", "vector")

    sizes = classes.groupBy("space").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.orderBy(F.desc("n"), "space").limit(most_pivots // 2).collect()  # a row per label, that many at most
    even = most_pivots // max(len(sizes), 1)
    wanted = {r["space"]: min(max(-(-r["n"] // cell), 2), even) for r in sizes}
    shares = [(r["space"], min(max(wanted[r["space"]], min(SAMPLE, even)) / r["n"], 1.0)) for r in sizes]
    sampled: dict[str, list] = {}
    if shares:
        share = heads.sparkSession.createDataFrame(shares, "space string, share double")
        chance = F.pmod(F.xxhash64("node"), F.lit(1 << 24)) / F.lit(1 << 24)
        picked = heads.join(F.broadcast(share), "space").where(chance < F.col("share"))
        picked = picked.orderBy(F.xxhash64("node"), "node").limit(most_pivots)
        for r in picked.select("space", "vector").collect():
            sampled.setdefault(r["space"], []).append(bytes(r["vector"]))
    units = {name: _unit(_matrix(pd.Series(v))) for name, v in sampled.items() if len(v) > 1}
    pivots = {name: _enough(x, wanted[name], radius, most_copies) for name, x in units.items()}

    parts = heads.mapInArrow(
        _cells(pivots, radius), "node long, space string, copies long, vector binary, cell int, home boolean"
    )
    parts = kept(parts, "cells")
    extent = parts.groupBy("space", "cell").agg(
        F.ceil(F.count_if("home") / block).alias("own_blocks"), F.ceil(F.count(F.lit(1)) / block).alias("blocks")
    )
    dealt = parts.join(extent.where("own_blocks > 0"), ["space", "cell"])
    mine = F.pmod(F.xxhash64("node"), F.col("own_blocks"))
    theirs = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    column = ["space", "cell", "node", "copies", "vector"]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    asking = dealt.where("home").select(*column, mine.cast("int").alias("i"), upto("blocks").alias("j"), F.lit(True).alias("own"))
    asked = dealt.select(*column, upto("own_blocks").alias("i"), theirs.cast("int").alias("j"), F.lit(False).alias("own"))
    found = asking.unionByName(asked).groupBy("space", "cell", "i", "j")
    found = kept(found.applyInPandas(_links(threshold), "node long, root long, links long"), "links")

    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(total, "node", "left").join(linked, F.col("node") == F.col("id"), "left")
    named = named.withColumn("of", F.coalesce("component", "node"))
    first = named.groupBy("of").agg(F.min("first_id").alias("least_id"))
    named = named.join(first, "of").select(
        F.col("print").alias("_print"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "least_id"
    )
    out = rows.select("vec_id", "print").join(named, F.col("print") == F.col("_print"), "left")
    component = F.when(F.col("print").isNull(), F.col("vec_id")).otherwise(F.col("least_id"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
