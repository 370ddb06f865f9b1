"""Terms of whole texts, in bulk: runs of the bytes of a class, only A-Z lower-cased.

All bytes of signs beyond ASCII belong to every class, so a run of bytes is a run of signs. A term never crosses texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.llm import textkit

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LETTERS_AND_DIGITS = LETTERS.copy()
LETTERS_AND_DIGITS[0x30:0x3A] = True
#: The same classes as patterns.
LETTER_RUN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LETTER_OR_DIGIT_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def column(text: Column, pattern: str) -> Column:
    """The terms of a text as an array, in the JVM. Null: empty."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(pattern), 0)


@dataclass
class Terms:
    letters: np.ndarray  # bytes of all terms, without what parts them
    length: np.ndarray  # of each term, in bytes
    first: np.ndarray  # for each text, and one more: number of terms before it

    def strings(self) -> pa.Array:
        ends = np.r_[0, np.cumsum(self.length)].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.length), pa.py_buffer(ends), pa.py_buffer(self.letters))

    def counted(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(different terms, place of the term, text, occurrences), a row for each term of each text, by term and text."""
        coded = self.strings().dictionary_encode()
        n = max(1, len(self.first) - 1)
        text = np.repeat(np.arange(n), np.diff(self.first)) if len(self.first) > 1 else np.zeros(0, np.int64)
        key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + text, return_counts=True)
        return coded.dictionary, key // n, key % n, tf

    def hashes(self, most: int | None = None) -> np.ndarray:
        """64-bit hash of each term, or of its first `most` bytes."""
        if not len(self.length):
            return np.zeros(0, np.uint64)
        at = np.cumsum(self.length) - self.length
        place = np.arange(len(self.letters)) - np.repeat(at, self.length)
        value = (self.letters.astype(np.uint64) + np.uint64(1)) * textkit.mix((place + 1).astype(np.uint64) * _GOLD)
        size = self.length
        if most is not None:
            value[place >= most] = 0
            size = np.minimum(size, most)
        return textkit.mix(np.add.reduceat(value, at) + size.astype(np.uint64) * _GOLD)


def terms(texts: pa.Array, member: np.ndarray) -> Terms:
    """Terms of an array of texts (null: none); member: which bytes belong to terms."""
    buf, off = textkit.raw(texts)
    if not len(buf):
        return Terms(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(len(off), np.int64))
    inside = member[buf]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin = edge == 1
    cut = off[:-1][off[:-1] < off[1:]]  # a text that begins with a term where the last one ended with one
    begin[cut] = inside[cut]
    start = np.flatnonzero(begin)
    letters = _LOW[buf[inside]]
    before = np.cumsum(inside)  # bytes of terms up to and with a place
    length = np.diff(np.r_[before[start] - 1, len(letters)])
    return Terms(letters, length.astype(np.int64), np.searchsorted(start, off))
