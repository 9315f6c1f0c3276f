"""SentencePiece sampling: forward filtering and backward sampling over the piece lattice.

A vocabulary whose pieces begin at white space lets a text fall into segments (a run of spaces and the word after it)
whose lattices are independent. A batch's distinct segments share one set of arrays: all their edges, the forward
log-sums, and per node the cumulated chances of the edges that end there. Each occurrence then walks back from its end,
with random numbers that depend on the row's key, the segment's place and the step alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import mixed, text_parts

SPACE = "▁"
LITERAL = "\ud800"  # stands for a SPACE sign of the text itself, which no piece may match
SHARPNESS = 1 / 2500  # by which scores are scaled before sampling
FALLBACK_SCORE = -60_000.0  # of a character that only bytes can spell
SLOT_BITS = 18
_SEGMENTS = re.compile(f"{SPACE}+[^{SPACE}]*")
_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(len(codes), _B), np.full(len(codes) + 1, _INVERSE)
    up[:1] = down[:1] = 1
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(up), out=sums[1:])
    return sums, np.multiply.accumulate(down)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Lattice:
    """All edges of several segments, sorted by the node where they end."""

    def __init__(self, model: PieceModel, segments: list[str]):
        codes = _codes("".join(segments))
        sizes = np.fromiter(map(len, segments), np.int32, len(segments))
        ends = np.cumsum(sizes, dtype=np.int32)  # positions in one batch's segments fit 32 bits
        of = np.repeat(np.arange(len(segments), dtype=np.int32), sizes)  # segment of each character
        sums, down = _prefix(codes)
        found = []
        at = np.arange(len(codes), dtype=np.int32)
        left = ends[of] - at
        for length in range(1, model.longest + 1):
            if length > 1:
                longer = left >= length
                at, left = at[longer], left[longer]
            if not len(at):
                break
            key = mixed((sums[at + length] - sums[at]) * down[at] + np.uint64(length))
            if length == 1:
                ids = model.find(key)
                found.append((at, 1, np.where(ids < 0, -1 - codes.astype(np.int32), ids)))
                continue
            maybe = np.flatnonzero(model.present[(key >> np.uint64(44)).view(np.int64)])
            ids = model.find(key[maybe])
            hit = ids >= 0
            found.append((at[maybe[hit]], length, ids[hit]))
        start = np.concatenate([f[0] for f in found])
        length = np.concatenate([np.full(len(f[0]), f[1], np.int32) for f in found])
        piece = np.concatenate([f[2] for f in found])
        del found, at, left, sums, down
        # Segment k has a node before and after each of its characters: its first one is its first character + k.
        first = ends - sizes + np.arange(len(segments), dtype=np.int32)
        source = start + of[start]
        node = source + length
        by = np.argsort(node.astype(np.int64) * (model.longest + 1) + length, kind="stable")  # few presorted runs
        node, source, piece = node[by], source[by], piece[by]
        del start, length, by
        weight = SHARPNESS * np.where(piece >= 0, model.scores[np.maximum(piece, 0)], FALLBACK_SCORE)
        head = np.flatnonzero(np.diff(node, prepend=-1))  # first edge of each node that has one
        size = np.diff(np.append(head, len(node)))
        total = np.zeros(len(codes) + len(segments))
        # Forward filter, all segments at once by distance from their start.
        place = node[head] - first[np.searchsorted(first, node[head], "right") - 1]
        steps = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place, kind="stable")
        cuts = np.flatnonzero(np.diff(place[steps], prepend=0))
        for k in np.split(steps, cuts[1:]) if len(cuts) else []:
            n = size[k]
            offset = np.cumsum(n) - n
            edge = np.repeat(head[k] - offset, n) + np.arange(int(n.sum()))
            value = total[source[edge]] + weight[edge]
            top = np.maximum.reduceat(value, offset)
            total[node[head[k]]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), offset))
        upto = np.exp(total[source] + weight - total[node])
        for r in range(1, int(size.max(initial=1))):
            k = head[size > r] + r
            upto[k] += upto[k - 1]
        self.limit = np.minimum((upto * 2.0**32).astype(np.uint64), np.uint64(2**32 - 1))
        self.limit[head + size - 1] = 2**32  # above every draw
        self.begin = np.zeros(len(total), np.int32)
        self.begin[node[head]] = head
        self.source, self.piece = source, piece
        self.end = first + sizes
        self.first = first
        # What an edge spells, as ids: one piece, or the bytes of a character.
        spelled = [model.byte_ids(-1 - int(p)) for p in self.piece[self.piece < 0]]
        self.width = np.ones(len(self.piece), np.int32)
        self.width[self.piece < 0] = [len(s) for s in spelled]
        self.offset = np.cumsum(self.width, dtype=np.int32) - self.width
        self.ids = np.zeros(int(self.width.sum()), np.int32)
        self.ids[self.offset] = np.maximum(self.piece, 0)
        for at, s in zip(self.offset[self.piece < 0], spelled, strict=True):
            self.ids[at : at + len(s)] = s

    def sample(self, segment: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one sampled path for each occurrence of a segment, in order, and how many each has."""
        node, first = self.end[segment].copy(), self.first[segment]
        active, steps = np.arange(len(segment)), []
        step = 0
        while len(active):
            draw = mixed(seed[active] ^ mixed(np.array([step], np.uint64))) >> np.uint64(32)
            edge = self.begin[node[active]]
            beyond = np.flatnonzero(self.limit[edge] <= draw)
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[self.limit[edge[beyond]] <= draw[beyond]]
            steps.append((active, edge))
            node[active] = self.source[edge]
            active = active[node[active] > first[active]]
            step += 1
        count = np.zeros(len(segment), np.int32)
        for at, _ in steps:
            count[at] += 1
        stop = np.cumsum(count, dtype=np.int64)
        edges = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        for k, (at, edge) in enumerate(steps):
            edges[stop[at] - 1 - k] = edge
        width = self.width[edges]
        into = np.cumsum(width, dtype=np.int32) - width
        ids = self.ids[np.repeat(self.offset[edges] - into, width) + np.arange(int(width.sum()), dtype=np.int32)]
        pieces = np.add.reduceat(width, stop - count) if len(stop) else count
        return ids, pieces


class PieceModel:
    """The pieces, scores and bytes of a SentencePiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = np.array([sp.get_score(i) for i in range(n)], float)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        bytes_of = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes = [bytes_of[b] for b in range(256)]
        usable = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("pieces that run across words are not supported")
        self.scores = np.where(self.scores < FALLBACK_SCORE, 0.0, self.scores)  # user-defined and unscored pieces
        self.longest = max(len(self.pieces[i]) for i in usable)
        keys, ids = [], []
        for i in usable:
            codes = _codes(self.pieces[i])
            sums, _ = _prefix(codes)
            keys.append(mixed(sums[-1:] + np.uint64(len(codes)))[0])
            ids.append(i)
        self._tables = []
        keys, ids = np.array(keys, np.uint64), np.array(ids, np.int32)
        self.present = np.zeros(1 << 20, bool)  # a quick first look
        self.present[(keys >> np.uint64(44)).astype(np.int64)] = True
        while len(keys):  # each table takes one key per slot, the next one what is left
            slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            _, taken = np.unique(slot, return_index=True)
            key, value = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
            key[slot[taken]], value[slot[taken]] = keys[taken], ids[taken]
            self._tables.append((key, value))
            rest = np.setdiff1d(np.arange(len(keys)), taken)
            keys, ids = keys[rest], ids[rest]
        self.spelling = [self._spelling(i, sp.is_byte(i), special[i]) for i in range(n)]

    def _spelling(self, i: int, is_byte: bool, special: bool) -> bytes:
        if is_byte:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if special else self.pieces[i].replace(SPACE, " ").encode()

    def byte_ids(self, code: int) -> list[int]:
        text = SPACE if chr(code) == LITERAL else chr(code)
        return [self.bytes[b] for b in text.encode()]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, -1 where there is none."""
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        for key, value in self._tables:
            out = np.where((out < 0) & (key[slot] == keys), value[slot], out)
        return out

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts in a row, and how many each text has. ``keys``: 64-bit seed of each text."""
        parted, sizes = [], []
        for t in texts:
            t = t or ""
            if SPACE in t:
                t = t.replace(SPACE, LITERAL)
            if not t:
                parts = []
            elif "  " in t or t[0] == " " or t[-1] == " ":
                parts = [s[1:] for s in _SEGMENTS.findall(SPACE + t.replace(" ", SPACE))]
            else:
                parts = t.split(" ")
            parted += parts
            sizes.append(len(parts))
        known = dict.fromkeys(parted)
        if not known:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        sizes = np.array(sizes, np.int64)
        begin = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        seed = mixed(np.repeat(keys, sizes) + mixed(place.astype(np.uint64) + np.uint64(1)))
        number = dict(zip(known, range(len(known)), strict=True)).__getitem__
        segment = np.fromiter(map(number, parted), np.int32, len(parted))
        ids, count = Lattice(self, [SPACE + p for p in known]).sample(segment, seed)
        upto = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        return ids, upto[begin + sizes] - upto[begin]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; exact for any path through the lattice."""
        return b"".join(map(self.spelling.__getitem__, ids.tolist()))[1:]


@cache
def piece_model(path: str) -> PieceModel:
    """One per worker process, kept between tasks."""
    return PieceModel(path)


def row_keys(doc_ids: list[int | None], seed: int) -> np.ndarray:
    values = np.array([0 if d is None else d for d in doc_ids], np.int64).view(np.uint64)
    known = np.array([d is not None for d in doc_ids], np.uint64)
    return mixed(mixed(values + known) + mixed(np.array([seed], np.int64).view(np.uint64)))


def _sampler(model: str, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for cut, part in text_parts(batch.column("text"), 4 << 20):
                ids, count = m.encode(part, row_keys(doc_ids[cut], seed))
                stop = np.cumsum(count)
                own = [ids[e - n : e] for e, n in zip(stop, count, strict=True)]
                columns = {
                    "doc_id": batch.column("doc_id").slice(cut.start, cut.stop - cut.start),
                    "n_pieces": pa.array(count, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4")) for x in own], pa.int64()),
                    "lossless": pa.array(
                        [m.decode(x) == (t or "").encode() for x, t in zip(own, part, strict=True)], pa.bool_()
                    ),
                }
                if with_ids:
                    columns["ids"] = pa.array(own, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def sampled_pieces(docs: DataFrame, model: str, seed: int = 1, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers), ``lossless``
    (decoding gives the text back), with ``with_ids`` also the ``ids``: one row per row of ``docs``.

    The segmentation depends on ``seed``, the doc_id and the text only, not on partitioning, so equal rows get equal
    ids; rows with a null doc_id share one seed. Null and empty texts have no pieces. Characters without a piece are
    spelled by bytes. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_sampler(model, seed, with_ids), schema)
