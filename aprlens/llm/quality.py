"""Quality rules: rule statistics of whole texts, and an isolation forest over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import release
from .words import Scan, text_parts

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_upper", "n_marks", "n_bars"]
#: What the forest splits on: shares and means of the counts, none of which grows with a text's length.
FEATURES = ["symbols", "dup_lines", "repeats", "upper", "marks", "bars", "word_length"]
#: Characters of the symbol rule.
SYMBOLS = b"#*$%&|<>"


def _mask(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _UPPER = _mask(SYMBOLS), _mask(bytes(range(65, 91)))
_MARK, _BAR, _BLANKS = _mask(b"!?"), _mask(b"|"), " \t\n\x0b\x0c\r"


def _repeats(scan: Scan, width: int = 3) -> np.ndarray:
    """Words of each text that lie in a window of ``width`` words found twice or more in that text."""
    keys, doc = scan.windows(width)
    if not len(keys):
        return np.zeros(scan.count, np.int64)
    order = np.lexsort((keys, doc))
    same = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(scan.hash), bool)
    n = len(scan.hash) - width + 1
    at = np.flatnonzero(scan.doc[:n] == scan.doc[width - 1 :])[twice]
    for k in range(width):
        covered[at + k] = True
    return np.bincount(scan.doc[covered], minlength=scan.count)


def counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of :data:`COUNTS` for each text; a null text counts as empty."""
    scan = Scan([None if t is None else t.encode() for t in texts])
    b, inside = scan.bytes, scan.inside
    chars = (b & 0xC0) != 0x80
    dup = []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.strip(_BLANKS)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.bincount(scan.doc, minlength=scan.count),
        "word_chars": scan.per_text(chars & inside),
        "n_symbols": scan.per_text(_SYMBOL[b]),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": _repeats(scan),
        "n_upper": scan.per_text(_UPPER[b]),
        "n_marks": scan.per_text(_MARK[b]),
        "n_bars": scan.per_text(_BAR[b]),
    }


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text: the columns of :data:`FEATURES`, zero for a text without words."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    parts = [
        c["n_symbols"] / chars,
        c["n_dup_lines"] / words,
        c["n_repeat_words"] / words,
        c["n_upper"] / chars,
        c["n_marks"] / chars,
        c["n_bars"] / chars,
        c["word_chars"] / words,
    ]
    return np.stack(parts, axis=1).astype(np.float64)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    value = 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Random isolation trees as arrays of (trees, nodes); node k has children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    norm: float
    depth: int
    threshold: float = float("inf")

    @classmethod
    def fit(
        cls, rows: np.ndarray, span: np.ndarray, trees: int = 128, sample: int = 256, depth: int = 10, seed: int = 7
    ) -> Forest:
        """Trees over random samples of ``rows``; cuts are drawn evenly from the box that ``span`` (two rows,
        least and greatest) and the cuts above leave, so they also fall where ``rows`` has nothing: what lies
        there is cut off after few splits."""
        rng = np.random.default_rng(seed)
        size = min(sample, len(rows))
        nodes = 2 ** (depth + 1) - 1
        forest = cls(
            np.full((trees, nodes), -1, np.int16),
            np.zeros((trees, nodes)),
            np.zeros((trees, nodes)),
            float(_average_path(np.array(size))) or 1.0,
            depth,
        )
        for tree in range(trees):
            pending = [(0, 0, rows[rng.choice(len(rows), size, replace=False)] if size else rows, span[0], span[1])]
            while pending:
                node, level, part, low, high = pending.pop()
                wide = np.flatnonzero(high > low)
                if level == depth or len(part) <= 1 or not len(wide):
                    forest.length[tree, node] = level + _average_path(np.array(len(part)))
                    continue
                f = int(rng.choice(wide))
                cut = rng.uniform(low[f], high[f])
                forest.feature[tree, node], forest.cut[tree, node] = f, cut
                left = part[:, f] < cut
                upto, above = high.copy(), low.copy()
                upto[f] = above[f] = cut
                pending.append((2 * node + 1, level + 1, part[left], low, upto))
                pending.append((2 * node + 2, level + 1, part[~left], above, high))
        return forest

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 ** -(mean path / expected path)."""
        total = np.zeros(len(rows))
        index = np.arange(len(rows))
        for tree in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            feature, cut = self.feature[tree], self.cut[tree]
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = rows[index, np.maximum(f, 0)] >= cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += self.length[tree, node]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.norm)


def calibrated(scores: np.ndarray, good: np.ndarray, most_lost: float) -> float:
    """The score that best parts the two classes (balanced accuracy) while at most ``most_lost`` of the good
    rows lie at or above it; infinite where either class is missing."""
    if not good.any() or good.all():
        return float("inf")
    candidates = np.unique(scores)
    g, b = np.sort(scores[good]), np.sort(scores[~good])
    lost = 1 - np.searchsorted(g, candidates, "left") / len(g)
    caught = 1 - np.searchsorted(b, candidates, "left") / len(b)
    allowed = lost <= most_lost
    if not allowed.any():
        return float("inf")
    best = np.max((caught - lost)[allowed])
    chosen = candidates[allowed & (caught - lost == best)].max()
    below = candidates[candidates < chosen]
    return float((below.max() + chosen) / 2) if len(below) else float(chosen)


STATISTICS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double"


def _scan_batches(forest: Forest | None, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part, texts in text_parts(batch.column("_text")):
                c = counts(texts)
                score = forest.score(features(c)) if forest else np.zeros(len(c["n_words"]))
                kept = batch.slice(part.start, part.stop - part.start)
                names = [n for n in batch.schema.names if with_text or n != "_text"]
                columns = [kept.column(n) for n in names]
                arrays = [pa.array(c[k].astype(np.int64)) for k in COUNTS]
                yield pa.RecordBatch.from_arrays([*columns, *arrays, pa.array(score)], [*names, *COUNTS, "anomaly"])

    return run


def statistics(docs: DataFrame, carried: list[str], forest: Forest | None = None) -> DataFrame:
    """``carried`` columns, :data:`COUNTS` and the forest's ``anomaly`` score (0 without one) of every row."""
    other = [c for c in carried if c != "text"]
    with_text = "text" in carried
    rows = docs.select(*[F.col(f"`{c}`") for c in other], F.col("text").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if with_text or f.name != "_text"]
    schema = ", ".join([*fields, STATISTICS_SCHEMA])
    return rows.mapInArrow(_scan_batches(forest, with_text), schema).withColumnRenamed("_text", "text")


def fitted(docs: DataFrame, labels: DataFrame, rows: int = 20_000, most_lost: float = 0.001) -> Forest:
    """A forest fitted and calibrated on labelled documents.

    ``rows`` bounds the labelled rows that are used: those with the smallest hash of their id, so the sample is
    even and repeatable. Trees split random samples of rows labelled good within the range of all labelled rows;
    the threshold is the one that parts good from bad best. Without labels the forest is empty and its threshold infinite.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .select("doc_id", F.col("quality").cast("int").alias("_good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_good")
        .limit(rows)
    )
    # At most ``rows`` rows: safe to broadcast, and only labelled texts are scanned.
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "_good")
    known = statistics(labelled, ["_good"]).orderBy(*COUNTS, "_good").limit(2 * rows).toPandas()
    known = known[~_base_failed(known)]
    x, good = features({k: known[k].to_numpy() for k in COUNTS}), known["_good"].to_numpy() == 1
    span = np.stack([x.min(0), x.max(0)]) if len(x) else np.zeros((2, len(FEATURES)))
    forest = Forest.fit(x[good] if good.any() else x, span)
    forest.threshold = calibrated(forest.score(x), good, most_lost) if len(x) else float("inf")
    return forest


def _base_failed(c):
    """The base rules; works on pandas and on Spark columns alike."""
    few = c["n_words"] < 50
    return few | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def quality_rules(docs: DataFrame, labels: DataFrame, carried: list[str] | None = None, **fit) -> DataFrame:
    """``carried`` columns (``doc_id`` by default), the counts, ``anomaly``, ``base_failed`` and ``kept``.

    A text is kept if it passes the base rules (50 words, at most half of them in repeated 3-word windows) and
    its anomaly score is below the calibrated threshold. Null and empty texts have zero words and are rejected;
    repeated rows each get their own row; an empty table gives an empty result; other columns are ignored.
    """
    forest = fitted(docs, labels, **fit)
    scored = statistics(docs, carried or ["doc_id"], forest)
    failed = _base_failed(scored)
    passed = F.col("anomaly") < F.lit(forest.threshold) if np.isfinite(forest.threshold) else F.lit(True)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passed)
