"""Vectorised word work on Arrow string columns: boundaries, 64-bit word hashes, hashes of word runs.

A word is a run of bytes other than ASCII white space (0x20, 0x09 to 0x0D). Everything works on whole texts; batches are
cut between documents so that a step holds a few MB, or one document where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(seed)) | np.uint64(1)


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `size` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    length = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(length) - length) // size
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, n], strict=True):
        yield batch.slice(int(a), int(b - a))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), and the offsets of the texts in them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    n = int(off[-1] - off[0])
    buf = np.frombuffer(texts.buffers()[2], np.uint8, n, int(off[0])) if n else np.zeros(0, np.uint8)
    return buf, off - off[0]


@dataclass
class Words:
    buf: np.ndarray  # bytes
    start: np.ndarray  # of each word, in buf
    end: np.ndarray
    first: np.ndarray  # for each document, and one more: number of words before it
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: pa.Array) -> Words:
    return words_of(*raw(texts))


def words_of(buf: np.ndarray, off: np.ndarray) -> Words:
    """Words of UTF-8 bytes; off: where each document begins, and the end."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, np.zeros(len(off), np.int64), np.zeros(0, np.uint64))
    word = ~_SPACE[buf]
    before = np.r_[False, word[:-1]]
    before[off[:-1][off[:-1] < len(buf)]] = False
    start = np.flatnonzero(word & ~before)
    after = np.r_[word[1:], False]
    after[off[1:] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(start, off)
    return Words(buf, start, end, first, _word_hash(buf[word], end - start))


def _word_hash(letters: np.ndarray, length: np.ndarray) -> np.ndarray:
    global _POW
    if not len(length):
        return np.zeros(0, np.uint64)
    longest = int(length.max())
    if longest > len(_POW):
        _POW = np.cumprod(np.full(longest, 0x100000001B3, np.uint64))
    at = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(at, length)
    value = _POW[place]
    value *= letters.astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(value, at) + length.astype(np.uint64) * _GOLD)


def runs(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of the k numbers from each place on; the last k-1 places have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(constants(k, seed)):
        out += h[j : j + n] * c
    return mix(out)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all documents in text order, and for each document (and one more) how many stand
    before it. A document with fewer than k words, but at least one, has one shingle of all its words."""
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.r_[0, np.cumsum(count)]
    out = np.zeros(first[-1], np.uint64)
    all_runs = runs(w.hash, k)
    long = n >= k
    if long.any():
        size = count[long]
        at = np.repeat(w.first[:-1][long] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        to = np.repeat(first[:-1][long] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[to] = all_runs[at]
    for d in np.flatnonzero(~long & (n > 0)):
        out[first[d]] = runs(w.hash[w.first[d] : w.first[d + 1]], int(n[d]), seed=1 + int(n[d]))[0]
    return out, first


def labelled(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes made different within each document: the second, third ... occurrence of a hash in a document gets a label."""
    if not len(h):
        return h
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])]
    place = np.arange(len(h))
    count = np.zeros(len(h), np.uint64)
    count[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    return mix(h + count * _GOLD)
