"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is how many distinct words of a text hold an n-gram of 3 to 6 characters, the word's borders included, in a
hashed bucket, divided by the root of the number of distinct words. The ratio of an n-gram is the log of its share among
toxic texts over its share among clean ones; features are multiplied by it and a logistic regression is fitted on them.

Features add up over words, so a fitted word is one number: texts are scored by looking up their distinct words, and
training multiplies by two thin tables (text to word, word to n-gram) and never lists the n-grams of a text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .words import mixed, text_parts

ORDERS = range(3, 7)
BUCKET_BITS = 20
FOLDS = 5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_WORD = re.compile(r"\w+")
_BORDER = "\n"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def distinct_words(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text; none for a null or empty one."""
    return set(_WORD.findall(text.lower())) if text else set()


def word_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the word and bucket of every n-gram of ``words``."""
    signs = np.frombuffer((_BORDER + _BORDER.join(words) + _BORDER).encode("utf-32-le", "surrogatepass"), np.uint32)
    border = signs == ord(_BORDER)
    owner = np.cumsum(border) - 1
    signs, found, buckets = signs.astype(np.uint64), [], []
    for n in ORDERS:
        starts = len(signs) - n + 1
        if starts <= 0:
            break
        total = np.full(starts, n, np.uint64)
        for k in range(n):
            total = total * _FACTOR + signs[k : k + starts]
        # A border may stand at either end of an n-gram, not within.
        inside = owner[n - 2 : n - 2 + starts] == owner[:starts]
        inside &= ~border[1 : 1 + starts]
        at = np.flatnonzero(inside)
        found.append(owner[at].astype(np.int32))
        buckets.append((mixed(total[at]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(found), np.concatenate(buckets)


def held_out(doc_id: Column) -> Column:
    """Rows no label is learnt from; a null id is one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


@dataclass
class Classifier:
    """``weights`` of the buckets (ratio times coefficient) and ``bias``."""

    weights: np.ndarray
    bias: float

    @staticmethod
    def constant(share: float) -> Classifier:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Classifier(np.zeros(1 << BUCKET_BITS), math.log(share / (1 - share)))

    @staticmethod
    def fit(texts: pa.ListArray, toxic: np.ndarray, share: float, smooth: float = 1.0, decay: float = 0.02) -> Classifier:
        """``texts`` as distinct words. ``share``: of toxic rows among all that are labelled, to which the classes are weighted.

        ``smooth`` is added to every n-gram's count, ``decay`` is the L2 penalty of a coefficient per row.
        """
        if toxic.all() or not toxic.any():
            return Classifier.constant(share)
        coded = texts.flatten().dictionary_encode()
        known, word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        sizes = texts.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        scale = 1 / np.sqrt(np.maximum(sizes, 1))
        holder, bucket = word_ngrams(known)
        used = np.flatnonzero(np.bincount(bucket, minlength=1 << BUCKET_BITS))
        place = np.zeros(1 << BUCKET_BITS, np.int32)
        place[used] = np.arange(len(used))
        bucket = place[bucket]

        def spread(v):  # texts x n-grams, times v
            by_word = np.bincount(holder, v[bucket], len(known))
            return np.bincount(row, by_word[word], len(texts)) * scale

        def gathered(u):  # the transposed product
            by_word = np.bincount(word, (u * scale)[row], len(known))
            return np.bincount(bucket, by_word[holder], len(used))

        counts = [gathered(side.astype(float)) + smooth / math.sqrt(len(texts)) for side in (toxic, ~toxic)]
        ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
        weight = np.where(toxic, share / toxic.sum(), (1 - share) / (~toxic).sum())
        coefficients, bias = _logistic(
            lambda v: spread(ratio * v), lambda u: ratio * gathered(u), len(used), toxic.astype(float), weight, decay / len(texts)
        )
        weights = np.zeros(1 << BUCKET_BITS)
        weights[used] = ratio * coefficients
        return Classifier(weights, bias)

    def of_words(self, words: list[str]) -> list[float]:
        if not words:
            return []
        holder, bucket = word_ngrams(words)
        return np.bincount(holder, self.weights[bucket], len(words)).tolist()


def _logistic(times, transposed, columns: int, y: np.ndarray, weight: np.ndarray, decay: float, rounds: int = 12):
    """Weighted logistic regression by Newton steps, each solved by conjugate gradients; the bias is not penalised."""
    v, bias = np.zeros(columns), float(np.log((weight @ y) / (weight @ (1 - y))))
    margin = np.full(len(y), bias)

    def loss(margin, v):
        return weight @ (np.logaddexp(0, margin) - y * margin) + decay / 2 * (v @ v)

    now = loss(margin, v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        off, curve = weight * (p - y), weight * p * (1 - p) + 1e-12
        slope = np.append(transposed(off) + decay * v, off.sum())

        def curved(d):
            u = curve * (times(d[:-1]) + d[-1])
            return np.append(transposed(u) + decay * d[:-1], u.sum())

        step, rest = np.zeros(columns + 1), -slope
        way, size = rest.copy(), rest @ rest
        goal = size * 1e-4
        for _ in range(15):
            if size <= goal or size < 1e-24:
                break
            bent = curved(way)
            far = size / (way @ bent)
            step += far * way
            rest -= far * bent
            size, was = rest @ rest, size
            way = rest + size / was * way
        moved, part = times(step[:-1]) + step[-1], 1.0
        while part > 1e-4 and loss(margin + part * moved, v + part * step[:-1]) > now:
            part /= 2
        margin, v, bias = margin + part * moved, v + part * step[:-1], bias + part * step[-1]
        was, now = now, loss(margin, v)
        if was - now < 1e-3 * was:
            break
    return v, bias


def fitted(docs: DataFrame, labels: DataFrame, rows: int = 2_000, learn: Column | None = None) -> Classifier:
    """A classifier fitted on labelled documents.

    ``rows`` bounds the documents used of each class: those with the smallest hash of their id, so the sample is even and
    repeatable. ``learn``, over ``doc_id``, says which labels may be used. Labels other than 0 and 1 are ignored, of
    several labels of a document the largest counts. With labels of one class only, every text scores that class's share.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if learn is not None:
        marked = marked.where(learn)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    total = {r["_toxic"]: r["count"] for r in marked.groupBy("_toxic").count().collect()}
    share = total.get(1, 0) / (sum(total.values()) or 1)
    drawn = [marked.where(F.col("_toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    # At most 2 * rows rows: safe to broadcast, and only their texts leave the scan.
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "_toxic", "text")
    sample = sample.mapInArrow(_word_batches, "doc_id long, toxic int, words array<string>")
    # Repeated rows count twice; in a fixed order, as sums depend on it.
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "words").limit(4 * rows).toArrow().combine_chunks()
    if not sample.num_rows:
        return Classifier.constant(share)
    words, toxic = (sample[c].combine_chunks() for c in ("words", "toxic"))
    return Classifier.fit(words, toxic.to_numpy() == 1, share)


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_parts(batch["text"]):
            words = pa.array([sorted(distinct_words(t)) for t in texts], pa.list_(pa.string()))
            ids, toxic = (batch[c].slice(part.start, part.stop - part.start) for c in ("doc_id", "_toxic"))
            yield pa.RecordBatch.from_arrays([ids, toxic, words], ["doc_id", "toxic", "words"])


class _Scorer:
    """Word scores are kept in two generations of at most ``most`` words, the older of which is dropped."""

    def __init__(self, classifier: Classifier, most: int = 300_000):
        self.classifier, self.most = classifier, most
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def scores(self, texts: list[str | None]) -> list[float]:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        words = [distinct_words(t) for t in texts]
        fresh = set().union(*words) - self.young.keys()
        known = fresh & self.old.keys()
        self.young.update((w, self.old[w]) for w in known)
        fresh = sorted(fresh - known)
        self.young.update(zip(fresh, self.classifier.of_words(fresh), strict=True))
        look, bias = self.young.__getitem__, self.classifier.bias
        # An exact sum: the order of a set does not show in the score.
        margins = [bias + math.fsum(map(look, w)) / math.sqrt(len(w)) if w else bias for w in words]
        return [1 / (1 + math.exp(-min(max(m, -500.0), 500.0))) for m in margins]


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A null or empty text, or one without words, gets the score of no evidence. Repeated rows each get their own row, an
    empty table gives an empty result, other columns are ignored, and texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((classifier.weights.astype(np.float32), classifier.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        scorer = _Scorer(Classifier(weights.astype(np.float64), bias))
        for batch in batches:
            for part, texts in text_parts(batch["text"]):
                score = scorer.scores(texts)
                columns = [batch[c].slice(part.start, part.stop - part.start) for c in ("doc_id", "held_out")]
                predicted = pa.array([int(s >= 0.5) for s in score], pa.int32())
                names = ["doc_id", "held_out", "score", "predicted"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64()), predicted], names)

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """:func:`scored` with a classifier fitted on the labelled rows outside the held-out fifth."""
    return scored(docs, fitted(docs, labels, learn=~held_out(F.col("doc_id")), **fit))
