"""Removal of word passages that an earlier document has too.

Seeds: from each run of `window` words the anchor is its SEED-word run with the least hash (the rightmost of equals), so two
documents that share a run share its anchor. Join: anchors are brought together by hash. Extension: an anchor is widened
both ways over all runs that chose it; where the widened passages are equal, the later document's is a repeat as a whole, else
the match is widened word by word: each run of `window` words around the anchor is compared with the runs of the others. The
union of what is found is the document's maximal repeats.

No pairs are made: for each passage only the least doc_id that has it counts. A task keeps one occurrence of a passage, the
least, in each BUFFER of anchors before anything is shuffled; an anchor that has several passages there is known to need the
word by word comparison, and only two of its rows go to the others of its hash. So neither a passage nor an anchor that a third
of all documents have makes a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm import textkit
from quarrylight.llm.common import broadcast_if_small, discard, written

WINDOW = 13
SEED = 4
#: Rows that a task brings together before it passes them on.
BUFFER = 1_000_000
#: What a row of _reduced says: its passage is to be compared; it is a repeat; it is to be compared word by word; it only shows
#: that its anchor has several passages.
PLAIN, REPEAT, UNSURE, MARK = range(4)


class _Runs:
    """The whole windows of a batch: their start words, documents, anchors and the hashes of runs."""

    def __init__(self, w: textkit.Words, window: int):
        self.w = w
        n = np.diff(w.first)
        doc = w.doc
        self.seed = textkit.runs(w.hash, SEED)
        wide = window - SEED + 1
        count = max(0, len(w.hash) - window + 1)
        self.valid = doc[:count] == doc[window - 1 : window - 1 + count] if count else np.zeros(0, bool)
        least = self.seed[:count].copy()
        for j in range(1, wide):
            np.minimum(least, self.seed[j : j + count], out=least)
        self.anchor = np.zeros(count, np.int64)
        place = np.arange(count)
        for j in range(wide):
            hit = self.seed[j : j + count] == least
            self.anchor[hit] = place[hit] + j
        self.doc, self.n = doc, n

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor: its word, and the first and last window that chose it."""
        start = np.flatnonzero(self.valid)
        if not len(start):
            return start, start, start
        a = self.anchor[start]
        head = np.r_[True, (a[1:] != a[:-1])]
        first = np.flatnonzero(head)
        last = np.r_[first[1:], len(start)] - 1
        return a[first], start[first], start[last]


def _passage_hash(w: textkit.Words, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of words a..b (not including b) and of the anchor's place in them."""
    width = b - a
    most = int(width.max()) if len(width) else 0
    out = np.zeros(len(a), np.uint64)
    for j, c in enumerate(textkit.constants(most, 77)):
        inside = width > j
        out[inside] += w.hash[a[inside] + j] * c
    return textkit.mix(out + (at - a).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + width.astype(np.uint64))


def _merge(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of word intervals [a, b) of each document."""
    if not len(a):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    shift = (doc - doc.min()) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + shift) - shift
    head = np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])]
    first = np.flatnonzero(head)
    return doc[first], a[first], np.maximum.reduceat(b, first)


def _reduced(h1, h2, doc, v, a, b, anchors: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the least document of each (h1, h2); the others' intervals are merged, as REPEAT. With `anchors` rows whose h1 has
    several h2 are UNSURE, and two MARKs stand for them. REPEAT and UNSURE rows have any number for h1, for even shuffles."""
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, v, a, b = h1[order], h2[order], doc[order], v[order], a[order], b[order]
    first = np.r_[True, h1[1:] != h1[:-1]]
    head = first | np.r_[True, h2[1:] != h2[:-1]]
    later = doc > doc[np.flatnonzero(head)][np.cumsum(head) - 1]
    kind = np.where(later, REPEAT, PLAIN).astype(np.int8)
    mark = np.zeros(0, np.int64)
    if anchors:
        begin = np.flatnonzero(first)
        several = np.add.reduceat(head.astype(np.int64), begin) > 1
        kind[np.repeat(several, np.diff(np.r_[begin, len(h1)])) & ~later] = UNSURE
        mark = np.r_[begin[several], np.r_[begin[1:], len(h1)][several] - 1]
    for some, what in ((kind == PLAIN, PLAIN), (kind == UNSURE, UNSURE), (kind == REPEAT, REPEAT)):
        d, u, x, y = doc[some], v[some], a[some], b[some]
        if what != PLAIN:
            if what == REPEAT and u.any():
                both, code = np.unique(np.stack([d, u], 1), axis=0, return_inverse=True)
                code, x, y = _merge(code.ravel(), x, y)
                d, u = both[code].T
            elif what == REPEAT:
                d, x, y = _merge(d, x, y)
                u = np.zeros(len(d), np.int64)
            k1, k2 = textkit.mix(d.astype(np.uint64) * np.uint64(31) + x.astype(np.uint64)).view(np.int64), None
        else:
            k1, k2 = h1[some], h2[some]
        yield from _rows(k1, k2, d, u, x, y, what)
    yield from _rows(h1[mark], h2[mark], doc[mark], v[mark], a[mark], b[mark], MARK)


def _rows(h1, h2, doc, v, a, b, what: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(doc), 200_000):
        k = slice(i, i + 200_000)
        n = len(doc[k])
        second = pa.nulls(n, pa.int64()) if h2 is None else pa.array(h2[k])
        yield pa.record_batch([pa.array(h1[k]), second, pa.array(doc[k]), pa.array(v[k]), pa.array(a[k].astype(np.int32)), pa.array(b[k].astype(np.int32)), pa.array(np.full(n, what, np.int8))], names=["h1", "h2", "doc_id", "v", "a", "b", "kind"])


def _buffered(anchors: bool, rows_of):
    """rows_of(piece): (h1, h2, doc_id, v, a, b) of a piece of a batch. Reduces BUFFER of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in textkit.chunks(batch):
                parts.append(rows_of(piece))
                held += len(parts[-1][0])
                if held >= BUFFER:
                    yield from _reduced(*(np.concatenate(x) for x in zip(*parts, strict=True)), anchors)
                    parts, held = [], 0
        if held:
            yield from _reduced(*(np.concatenate(x) for x in zip(*parts, strict=True)), anchors)

    return run


def _occurrences(window: int):
    """Of each anchor: its hash, the passage's hash, document, word interval."""

    def rows_of(piece: pa.RecordBatch):
        w = textkit.words(piece.column("text"))
        r = _Runs(w, window)
        at, s, e = r.spans()
        doc = r.doc[at]
        base = w.first[:-1][doc]
        return r.seed[at].view(np.int64), _passage_hash(w, s, e + window, at).view(np.int64), piece.column("doc_id").to_numpy()[doc], piece.column("v").to_numpy()[doc], s - base, e + window - base

    return rows_of


def _windows(window: int):
    """Of each window in `spans`: two hashes, document, word interval."""

    def rows_of(piece: pa.RecordBatch):
        w = textkit.words(piece.column("text"))
        one, two = textkit.runs(w.hash, window, 5), textkit.runs(w.hash, window, 6)
        spans = piece.column("spans")
        n = spans.value_lengths().to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        a = flat.field("a").to_numpy().astype(np.int64)
        count = flat.field("b").to_numpy().astype(np.int64) - a - window + 1
        doc = np.repeat(np.repeat(np.arange(piece.num_rows), n), count)
        start = np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())
        at = w.first[:-1][doc] + start
        return one[at].view(np.int64), two[at].view(np.int64), piece.column("doc_id").to_numpy()[doc], piece.column("v").to_numpy()[doc], start, start + window

    return rows_of


ROW = "h1 long, h2 long, doc_id long, v long, a int, b int, kind byte"


def told_apart(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with v: 0, or a hash of the text where rows of several texts have the same doc_id."""
    t = F.xxhash64("text")
    several = docs.select("doc_id", t.alias("t")).where("doc_id is not null").groupBy("doc_id").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low < high").select("doc_id", F.lit(True).alias("several"))
    some = written(several, "repeated-ids")
    return docs.join(broadcast_if_small(some), "doc_id", "left").select("doc_id", "text", F.when(F.col("several"), t).otherwise(0).alias("v"))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, v, spans): for each document with repeats, word intervals [a, b) whose every window starts in an earlier
    document too. docs: non-null doc_id (long), text without nulls, v as `told_apart` gives it. The intervals may overlap."""
    found = docs.mapInArrow(_buffered(True, _occurrences(window)), ROW)
    anchor, passage = Window.partitionBy("h1"), Window.partitionBy("h1", "h2")
    seen = found.withColumn("least", F.min("doc_id").over(passage)).withColumn("low", F.min("h2").over(anchor)).withColumn("high", F.max("h2").over(anchor))
    again = (F.col("kind") == REPEAT) | ((F.col("kind") == PLAIN) & (F.col("doc_id") > F.col("least")))
    seen = seen.where(f"kind <> {MARK}").withColumn("repeat", again).where(f"repeat or kind = {UNSURE} or low < high")
    seen = written(seen.select("doc_id", "v", "a", "b", "repeat"), "passages")
    unsure = written(seen.where("not repeat").groupBy("doc_id", "v").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "unsure")
    near = docs.join(broadcast_if_small(unsure), ["doc_id", "v"]).mapInArrow(_buffered(False, _windows(window)), ROW)
    more = near.withColumn("least", F.min("doc_id").over(passage)).where(f"kind = {REPEAT} or doc_id > least").select("doc_id", "v", "a", "b")
    out = written(seen.where("repeat").select("doc_id", "v", "a", "b").union(more).groupBy("doc_id", "v").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "repeats")
    discard(seen, unsure)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, and with keep_text the kept words joined by spaces).

    Rows without a doc_id lose nothing. Rows that repeat one are judged each by its own text: what starts in a smaller id goes,
    what they share with each other stays. Null text has no words; a text shorter than the window loses nothing. No
    rows: no rows. Other columns are ignored, whatever their names.
    """
    plain = told_apart(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
    spans = repeats(plain.where("doc_id is not null"), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textkit.chunks(batch):
                n_words, n_removed, digests, kept_texts = [], [], [], []
                for t, cut in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
                    words = t.encode().split()
                    stay = np.ones(len(words), bool)
                    for s in cut or ():
                        stay[s["a"] : s["b"]] = False
                    kept = b" ".join(words if not cut else [words[i] for i in np.flatnonzero(stay).tolist()])
                    n_words.append(len(words))
                    n_removed.append(len(words) - int(stay.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        kept_texts.append(kept.decode())
                columns = [piece.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)]
                yield pa.record_batch(columns + [pa.array(kept_texts, pa.string())] * keep_text, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + keep_text])

    joined = plain.join(broadcast_if_small(spans), ["doc_id", "v"], "left")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
