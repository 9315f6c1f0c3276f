"""Embedding join and SetSketch dedup against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np

from aprlens.llm import embed_dedup, setsketch
from aprlens.llm.shared import components

from .conftest import WORD, lowered


def least_reachable(ids, links):
    reach = list(ids)
    changed = True
    while changed:
        changed = False
        for i, j in links:
            known = [x for x in (reach[i], reach[j]) if x is not None]
            low = min(known) if known else None
            if reach[i] != low or reach[j] != low:
                reach[i] = reach[j] = low
                changed = True
    return reach


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, rng.randint(101, 140)) for _ in range(60)] + [(200, 200), (7, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    expected = least_reachable(nodes, [(at[a], at[b]) for a, b in edges])
    assert {(r["id"], r["component"]) for r in found} == set(zip(nodes, expected, strict=True))


def test_range_join_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    seeds = rng.normal(size=(12, 8))
    rows = []
    for i in range(160):
        v = seeds[rng.integers(12)] + rng.normal(size=8) * 0.3
        rows.append((i, [float(x) for x in v], int(rng.integers(3)) if i % 17 else None))
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[1][1], rows[1][2]), (201, rows[1][1], rows[1][2])]
    rows += [(202, None, 1), (203, [0.0] * 8, 1), (204, [float("nan")] + [1.0] * 7, 1), (205, [None] + [1.0] * 7, 1)]
    rows += [(206, [1.0, 2.0], 1), (207, [1e300, 2e300], 1), (None, rows[2][1], rows[2][2]), (208, [], 1)]

    def usable(v):
        return v and None not in v and all(map(math.isfinite, v)) and any(v)

    def cosine(v, w):
        v, w = np.array(v) / max(map(abs, v)), np.array(w) / max(map(abs, w))
        return v @ w / np.linalg.norm(v) / np.linalg.norm(w)

    links = [
        (i, j)
        for i, (_, v, a) in enumerate(rows)
        for j, (_, w, b) in enumerate(rows)
        if i != j and a is not None and a == b and usable(v) and usable(w) and len(v) == len(w) and cosine(v, w) >= 0.93
    ]
    reach = least_reachable([r[0] for r in rows], links)
    expected = sorted(((r[0], sum(i == k for k, _ in links), c) for i, (r, c) in enumerate(zip(rows, reach, strict=True))), key=str)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, row int")
    for knobs in ({}, {"block": 9, "cell": 20}, {"block": 30, "cell": 10, "most_pivots": 5}, {"cell": 4, "most_copies": 99.0}):
        found = embed_dedup.range_join(df, 0.93, **knobs).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=str) == expected
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert embed_dedup.range_join(df.limit(0)).count() == 0


def test_pivots_are_taken_while_copies_stay_few():
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scattered = unit(rng.normal(size=(64, 64)))
    grouped = unit(np.repeat(np.eye(64)[:4], 16, 0) + rng.normal(size=(64, 64)) * 0.001)[rng.permutation(64)]
    radius = math.sqrt(2 - 2 * 0.93)
    assert len(embed_dedup._enough(scattered, 32, radius, 2.5)) == 2
    assert len(embed_dedup._enough(grouped, 32, radius, 2.5)) >= 4
    own, near = embed_dedup._reach(grouped, grouped[:8], radius)
    for i in range(64):  # whoever is within the radius is sent to the home cell
        linked = np.flatnonzero(grouped @ grouped[i] >= 0.93)
        assert near[linked, own[i]].all()


def shingles(text):
    words = WORD.findall(lowered(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def test_near_duplicates_equal_all_pairs(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets)
        if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b)
    ]
    reach = least_reachable([d for d, _ in rows], links)
    expected = sorted(((d, len(s), c) for (d, _), s, c in zip(rows, sets, reach, strict=True)), key=str)
    found = setsketch.near_duplicates(odd_docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert sum(r["head"] for r in found) == len(rows) - 5  # 4; 6, 6, 7 and the null id are not first
    assert setsketch.near_duplicates(no_docs).count() == 0


def test_unlike_members_of_one_bucket_are_all_compared(spark):
    """A long shared passage puts unlike texts into common buckets; their near copies must still be found."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(12):
        own = [word() for _ in range(30)]
        rows.append((2 * i, " ".join(passage + own)))
        rows.append((2 * i + 1, " ".join(passage + own[:-1] + [word()])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for knobs in ({}, {"small_bucket": 3, "block": 5}):
        found = setsketch.near_duplicates(docs, **knobs).collect()
        assert {(r["doc_id"], r["component_id"]) for r in found} == {(i, i - i % 2) for i in range(24)}


def test_blocks_without_classes(spark):
    """Long texts get so small blocks that some hold no class: here as many blocks as classes."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(12):
        own = [word() for _ in range(30)]
        rows.append((2 * i, " ".join(passage + own)))
        rows.append((2 * i + 1, " ".join(passage + own[:-1] + [word()])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = setsketch.near_duplicates(docs, small_bucket=3, block=1).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(i, i - i % 2) for i in range(24)}


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(2))
    b[:2000] = a[:2000]
    ra, rb = setsketch.sketch(a), setsketch.sketch(b)
    assert (setsketch.merged(ra, rb) == setsketch.sketch(np.union1d(a, b))).all()
    n = np.array([3000.0])
    best, _ = setsketch.estimate(n, n, ra[None], rb[None])
    assert abs(best[0] - 0.5) < 0.12
    best, _ = setsketch.estimate(n, n, ra[None], ra[None])
    assert best[0] > 0.99
