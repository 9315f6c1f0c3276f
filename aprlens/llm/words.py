"""Numpy scan of whole texts into word hashes; used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20  # bytes hashed at once; a longer word makes its piece longer
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if 0 not in _powers or len(_powers[0][0]) < n:
        size = max(n, 2 * PIECE)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[0]


class Scan:
    """The words of several texts: 64-bit ``hash``, ``start`` and ``end`` in ``bytes``, and ``doc`` of each.

    Words are maximal runs outside blanks (space, TAB to CR). Null texts count as empty. ``bounds[i]`` is the
    first byte of text i; a blank follows each text.
    """

    def __init__(self, texts: list[bytes | None], fold: np.ndarray = PLAIN):
        self.count = len(texts)
        raw = b" ".join([t or b"" for t in texts]) + b" "
        self.bytes = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, self.count)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        inside = ~BLANK[self.bytes]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.bounds, self.start, "right") - 1
        self.inside = inside
        self.hash = self._hashes(fold)

    def _hashes(self, fold: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        first = 0
        while first < len(self.start):
            base = self.start[first]
            last = max(int(np.searchsorted(self.end, base + PIECE, "right")), first + 1)
            piece = fold[self.bytes[base : self.end[last - 1]]].astype(np.uint64)
            up, down = _power_tables(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece + np.uint64(1)) * up[: len(piece)], out=sums[1:])
            s, e = self.start[first:last] - base, self.end[first:last] - base
            out[first:last] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _BASE)
            first = last
        return out

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of every run of ``width`` words within one text, in order."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total = total * _BASE + self.hash[k : k + n]
        whole = self.doc[:n] == self.doc[width - 1 :]
        return mixed(total[whole]), self.doc[:n][whole]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def text_parts(column: pa.Array, limit: int = 2 * PIECE) -> Iterator[tuple[slice, list[str | None]]]:
    """Cuts a column of texts so that each part holds about ``limit`` bytes, one text at least; only a part's texts are
    Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first = total = 0
    for i, size in enumerate([*sizes, limit + 1]):
        if i > first and (total + size > limit or i == len(sizes)):
            yield slice(first, i), column.slice(first, i - first).to_pylist()
            first, total = i, 0
        total += size
