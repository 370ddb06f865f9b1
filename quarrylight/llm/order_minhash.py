"""Near duplicates by order MinHash.

Each of SKETCHES seeded hashes picks the LENGTH least of a text's occurrence-labelled k-mers of K words and keeps them in text
order, so a sketch agrees for two texts if they share these k-mers in the same order: the chance follows edit similarity, not
only the sets. A sketch is a band key. Texts of few words lose most k-mers by few edits; they have as many more keys of
SHORT_LENGTH k-mers. Candidates are verified by banded alignment of their words: edit similarity is 1 - d / max(n1, n2) with d
the least number of inserted, deleted and replaced words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylight.llm import similar, textkit

#: Words that an alignment's anchors have.
ANCHOR = 5
#: With edits at random places a pair at similarity 0.8 shares 0.47 of its k-mers, and so a sketch with the chance 0.47^3 = 0.104
#: and one of the 64 with 0.999.
K = 2
LENGTH = 3
SKETCHES = 64
#: Texts of so many words or fewer have keys of both lengths: a pair with a longer text has 0.8 as many words each at least.
SHORT_WORDS = 60
SHORT_LENGTH = 2
SIMILARITY = 0.8
#: Values of a text that are put in order for a sketch, on average.
FEW = 14


def sketches(w: textkit.Words, length: int = LENGTH, seed: int = 21) -> np.ndarray:
    """uint64 for each text and sketch; 0 for texts without words. A text of fewer k-mers has all of them in each sketch."""
    h, first = textkit.shingles(w, K)
    n = np.diff(first)
    out = np.zeros((len(n), SKETCHES), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    h = textkit.labelled(h, first)
    begin, size = first[:-1][full], n[full]
    owner = np.repeat(np.arange(len(full)), size)
    # a bound that about FEW values of a text keep below, so that only those are put in order
    limit = np.repeat(np.where(size > FEW, np.minimum(FEW / size, 0.99) * 2.0**64, 0).astype(np.uint64), size)
    limit[np.repeat(size <= FEW, size)] = np.uint64(0xFFFFFFFFFFFFFFFF)
    want = np.minimum(size, length)
    factor, shift = textkit.constants(SKETCHES, seed), textkit.constants(SKETCHES, seed + 1)
    value = np.empty_like(h)
    weight = textkit.constants(length, seed + 2)
    for j in range(SKETCHES):
        np.multiply(h, factor[j], out=value)
        value += shift[j]
        low = np.flatnonzero(value <= limit)
        of = owner[low]
        low = low[np.argsort((of.astype(np.uint64) << np.uint64(40)) | (value[low] >> np.uint64(24)))]
        count = np.bincount(of, minlength=len(full))
        at = np.cumsum(count) - count
        picked = np.full((length, len(full)), np.iinfo(np.int64).max)
        for r in range(length):
            there = count > r
            picked[r, there] = low[at[there] + r]
        for x in np.flatnonzero(count < want).tolist():
            picked[: want[x], x] = begin[x] + np.argsort(value[begin[x] : begin[x] + size[x]])[: want[x]]
        picked.sort(0)
        for r in range(length):
            there = size > r
            out[full[there], j] += h[picked[r, there]] * weight[r]
    out[full] = textkit.mix(out[full]) | np.uint64(1)
    return out


def band_keys(w: textkit.Words) -> np.ndarray:
    n = np.diff(w.first)
    keys = np.zeros((len(n), 2 * SKETCHES), np.uint64)
    keys[:, :SKETCHES] = sketches(w)
    short = n <= SHORT_WORDS
    kept = np.repeat(short, n)
    few = textkit.Words(w.buf, w.start[kept], w.end[kept], np.r_[0, np.cumsum(n[short])], w.hash[kept])
    keys[short, SKETCHES:] = sketches(few, SHORT_LENGTH, 31)
    return keys


def forms(w: textkit.Words) -> list[np.ndarray]:
    """Words of each text in order, as hashes of 32 bits."""
    short = (w.hash >> np.uint64(32)).astype(np.uint32)
    return [short[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def _common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words that both have, counted as often as both have them."""
    both = np.sort(np.r_[a, b])
    kind = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    total = np.diff(np.r_[kind, len(both)])
    mine = np.searchsorted(np.sort(a), both[kind], side="right") - np.searchsorted(np.sort(a), both[kind])
    return int(np.minimum(mine, total - mine).sum())


def _anchored(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """An alignment's cost, at least the true distance: k-mers that both have once, near the diagonal and in the same order, are
    laid on one another; between them each word more or other costs one."""
    one, two = (textkit.runs(x.astype(np.uint64), ANCHOR) for x in (a, b))
    _, i, j = np.intersect1d(*(textkit.labelled(x, np.array([0, len(x)])) for x in (one, two)), return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    order = np.argsort(i)
    i, j = i[order], j[order]
    ahead = np.r_[-1, np.maximum.accumulate(j)[:-1]] if len(j) else j
    i, j = i[j > ahead], j[j > ahead]
    # gaps before the first, between two, and behind the last; k-mers of one diagonal that overlap have none
    x, y = np.diff(np.r_[-ANCHOR, i, len(a)]) - ANCHOR, np.diff(np.r_[-ANCHOR, j, len(b)]) - ANCHOR
    overlap = np.minimum(np.minimum(x, y), 0)
    return int(np.maximum(x - overlap, y - overlap).sum())


def banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance of word sequences if it is `band` or less, else a number above band. Row by row; only cells within `band`
    of the diagonal."""
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return band + 1
    far = n + m
    width = 2 * band + 1
    step = np.arange(width)
    row = np.where((step - band >= 0) & (step - band <= m), step - band, far)  # cell c of row i stands for column i + c - band
    padded = np.full(m + 2 * width + n, 0, np.int64) - 1
    padded[width : width + m] = b
    for i in range(1, n + 1):
        j0 = i - band
        letters = padded[width + j0 - 1 : width + j0 - 1 + width]
        new = row + (letters != int(a[i - 1]))
        up = np.r_[row[1:], far] + 1
        np.minimum(new, up, out=new)
        if j0 <= 0:
            new[:-j0] = far
            new[-j0] = i
        if j0 + width - 1 > m:
            new[m - j0 + 1 :] = far
        row = np.minimum.accumulate(new - step) + step
        if row.min() > band:
            return band + 1
    return int(row[m - n + band])


def edit_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - d / max(n1, n2) if that is `least` or more, else some number below `least`. With a close bound from shared k-mers the
    table is not needed: then the similarity may be understated, but not below `least`."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    band = int((1 - least) * longest + 1e-9)
    if longest - _common_words(a, b) > band:
        return 0.0
    cost = _anchored(a, b, band) if min(len(a), len(b)) >= ANCHOR else longest
    if cost > band:
        cost = banded_distance(a, b, band)
    return 1 - cost / longest if cost <= band else 0.0


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row: classes are connected components of pairs with edit similarity of words of
    `similarity` or more and of exact copies, named by their least doc_id. Two texts are compared if a band of their sketches
    agrees. Nulls, repeated ids, empty texts: see `similar.classes`."""
    def near(both: np.ndarray, others: np.ndarray, one: int) -> np.ndarray:
        longest = np.maximum(others, one)
        return longest - both <= np.floor((1 - similarity) * longest + 1e-9)

    method = similar.Method(keys=band_keys, forms=forms, alike=lambda a, b: edit_similarity(a, b, similarity) >= similarity, near=near, least_length=similarity)
    return similar.classes(docs, method, doc_id, text)
