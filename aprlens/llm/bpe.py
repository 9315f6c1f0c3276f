"""Byte-level BPE ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

A text is cut only where the vocabulary's own word pattern always cuts: before a single space, and around a single
line break. Texts with other white space, with runs of it or with the content of an added token go to the library whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from functools import cache, lru_cache

import regex

# The published word pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space other than single spaces and line breaks between words.
_ODD_SPACES = [*map(chr, [9, 11, 12, 13, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
_RUNS = ["  ", "\n\n", " \n", "\n ", *_ODD_SPACES]
_WORDS = regex.compile(PATTERN)
# The same for ASCII text, where the standard module is faster.
# White space is space, TAB to CR in it: U+001C to U+001F are signs to the library, not blanks.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_MARKS = ".,;:!?"
_FAMILIAR = "\u0530"  # letters below are classed alike by the library and by ``regex``; others go to the library


def _byte_letters() -> str:
    """The printable stand-in of each byte: itself, or the next letter from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(spare)) for b in range(256))


class _Words(dict):
    """Ids of the words that follow ``prefix`` (nothing or a space), encoded when they are first asked for.

    Two generations of at most ``most`` words are kept; the older one is dropped whole, so that frequent words stay.
    """

    def __init__(self, bpe: Bpe, prefix: str, most: int):
        super().__init__()
        self.bpe, self.prefix, self.most, self.old = bpe, prefix, most, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            if "\n" in unit:  # around a single line break the pattern always cuts
                head, *lines = unit.split("\n")
                return self.bpe.line_break.join([self[head], *map(self.bpe.bare.__getitem__, lines)])
            ids = self._encoded(unit)
        self[unit] = ids
        return ids

    def _encoded(self, unit: str) -> bytes:
        # Most are a word of plain letters, or one with sentence marks behind it, which the pattern parts there.
        word = unit.rstrip(_MARKS)
        if word.isalpha() and (word.isascii() or max(word) < _FAMILIAR):
            if word is unit:
                return self.bpe.plain_word(self.prefix + unit)
            return self[word] + self.bpe.marks(unit[len(word) :])
        return self.bpe.mixed(self.prefix + unit)

    def trimmed(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Bpe:
    """Ids as packed little-endian unsigned 32-bit integers. ``most`` bounds a generation of each word table. ``added``: a
    special token's content in a text is that token, as by the library's default, and not plain signs."""

    def __init__(self, path: str, most: int = 200_000, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not added
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()] if added else []
        self.whole_texts = [*_RUNS, *self.added]
        self.tokenize = self.whole.model.tokenize
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.bare, self.spaced = _Words(self, "", most), _Words(self, " ", most)
        self.marks = lru_cache(maxsize=1_000)(self.plain_word)
        self.line_break = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def plain_word(self, word: str) -> bytes:
        """Ids of one match of the pattern."""
        if word.isascii() and word.isprintable():  # shown as it is, but for the blank
            shown = word.replace(" ", self.letters[32])
        else:
            shown = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def mixed(self, text: str) -> bytes:
        """Ids of several matches: letters, digits and marks."""
        if not text.isascii() and max(text) >= _FAMILIAR:
            return self._ids(text)
        pattern = _ASCII_WORDS if text.isascii() else _WORDS
        return b"".join([
            self.spaced[w[1:]] if w[0] == " " and w[1:].isalpha() else self.bare[w] if w.isalpha() else self.plain_word(w)
            for w in pattern.findall(text)
        ])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for a null or empty one."""
        out = []
        for text in texts:
            self.bare.trimmed()
            self.spaced.trimmed()
            if not text:
                out.append(b"")
            elif text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, self.whole_texts)):
                out.append(self._ids(text))
            else:
                first, *rest = text.split(" ")
                out.append(self.bare[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return out


@cache
def encoder(path: str) -> Bpe:
    """One per worker process, kept between tasks; with the library's defaults."""
    return Bpe(path, added=True)


def release() -> None:
    """Gives back what :func:`encoder` kept, when a task of another operator begins in the same worker."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # the tables and their encoder name each other
