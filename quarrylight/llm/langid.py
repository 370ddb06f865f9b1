"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over bytes: counts of what followed every context of 0 to 3 bytes. A byte
seen in a context costs -log2(count / (total + distinct)); an unseen one costs the escape
-log2(distinct / (total + distinct)) and is then looked for in the next shorter context; below order 0 all bytes are equally
likely (escape method C, no exclusion). A context never seen is skipped at no cost. The statistics are frozen after training;
the cost of a text in a language is the sum over its bytes, and the cheapest language wins.

The trees are sparse: of each order only the contexts and bytes that were seen are stored, found by a hash table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm import textkit
from quarrylight.llm.common import fresh

ORDER = 3
#: Nodes of the deepest level of each language's tree, the commonest; a bound of the model's size, the same for each language.
MAX_NODES = 1_000_000
#: Score lies between 0 and 1: posterior of the best language with code lengths spread over this many bytes at most.
EVIDENCE_BYTES = 64
UNKNOWN = "und"
#: Bytes that are counted, and that are scored, at once; what a step holds is about 100 bytes for each in either, however long
#: the texts are.
COUNT_STEP = 1 << 20
SCORE_STEP = 1 << 18
#: What stands before a text.
BEGIN = 10


class _Index:
    """Rows of ascending uint32 codes by open addressing; -1 for codes that aren't there."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = max(8, (4 * len(codes)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(codes), dtype=np.int32), self._place(codes)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & (len(self.slots) - 1)

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        at = self._place(codes)
        row = self.slots[at]
        left = np.flatnonzero(row >= 0)
        left = left[self.codes[row[left]] != codes[left]]
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            row[left] = self.slots[at[left]]
            left = left[row[left] >= 0]
            left = left[self.codes[row[left]] != codes[left]]
        return row


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # uint32 codes of a byte (lowest) and the three before it, that some language has, ascending
    counts: np.ndarray  # of each gram and language
    _ready: list | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def levels(self) -> list[tuple[_Index, np.ndarray, _Index, np.ndarray]]:
        """For each order: grams and what they cost in each language, contexts and their escapes."""
        if self._ready is None:
            self._ready = []
            n_lang = len(self.langs)
            for order in range(ORDER + 1):
                of = self.grams & np.uint32(2 ** (8 * order + 8) - 1)
                codes, at = np.unique(of, return_inverse=True)
                count = np.stack([np.bincount(at, self.counts[:, j], len(codes)) for j in range(n_lang)], 1)
                context, where = np.unique(codes >> np.uint32(8), return_inverse=True)
                total = np.stack([np.bincount(where, count[:, j], len(context)) for j in range(n_lang)], 1)
                distinct = np.stack([np.bincount(where, count[:, j] > 0, len(context)) for j in range(n_lang)], 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                    seen = -np.log2(count / (total + distinct)[where])
                shorter = self._ready[-1][1][self._ready[-1][0].rows(codes & np.uint32(2 ** (8 * order) - 1))] if order else 8.0
                self._ready.append((_Index(codes), np.where(count > 0, seen, escape[where] + shorter), _Index(context), escape))
        return self._ready

    def _cost(self, gram: np.ndarray, order: int) -> np.ndarray:
        if order < 0:
            return np.full((len(gram), len(self.langs)), 8.0)
        index, cost, contexts, escape = self.levels()[order]
        row = index.rows(gram)
        out = cost[row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            at = contexts.rows(gram[miss] >> np.uint32(8))
            out[miss] = np.where((at >= 0)[:, None], escape[at], 0.0) + self._cost(gram[miss] & np.uint32(2 ** (8 * order) - 1), order - 1)
        return out

    def bits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each text in each language. A text's first bytes follow the byte of a line end."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        if not len(buf):
            return out
        gram = _grams(buf, off)
        for a, part in _steps(off, SCORE_STEP):
            full = np.flatnonzero(np.diff(part))
            out[full] += np.add.reduceat(self._cost(gram[a : a + int(part[-1])], ORDER), part[:-1][full], axis=0)
        return out


def _steps(off: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Where each `size` bytes begin, and the offsets in them of the texts (those that have no byte there are empty)."""
    for a in range(0, int(off[-1]), size):
        yield a, np.clip(off, a, min(a + size, int(off[-1]))) - a


def _grams(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code of each byte with the three before it in its own text."""
    gram = s.astype(np.uint32)
    first = off[:-1][np.diff(off) > 0]
    length = np.diff(off)[np.diff(off) > 0]
    for back in range(1, ORDER + 1):
        before = np.full(len(s), BEGIN, np.uint32)
        before[back:] = s[:-back] if back < len(s) else s[:0]
        for k in range(back):
            before[(first + k)[length > k]] = BEGIN
        gram += before << np.uint32(8 * back)
    return gram


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_nodes: int = MAX_NODES) -> Model:
    """Counts over every whole text with a non-null language. Null texts count as empty. What reaches the driver is a row for
    each gram and language, at most max_nodes of a language, however large the corpus and whatever the other languages have.

    No labelled text: a model of no languages, which predicts `und` for all.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("lang is not null")

    def each_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in textkit.chunks(batch):
                names = piece.column("lang").to_pylist()
                buf, off = textkit.raw(piece.column("text"))
                gram = _grams(buf, off)
                code = {x: i for i, x in enumerate(sorted(set(names)))}
                of = np.array([code[x] for x in names], np.int32)
                for a, part in _steps(off, COUNT_STEP):
                    owner = np.repeat(of, np.diff(part))
                    for x, i in code.items():
                        key, n = np.unique(gram[a : a + len(owner)][owner == i], return_counts=True)
                        old = totals.get(x)
                        if old is not None:
                            key, at = np.unique(np.r_[old[0], key], return_inverse=True)
                            n = np.bincount(at, np.r_[old[1], n]).astype(np.int64)
                        totals[x] = np.stack([key.astype(np.int64), n])
        for x, (key, n) in totals.items():
            yield pa.record_batch([pa.array([x] * len(key)), key, n], names=["lang", "gram", "n"])

    grams = rows.mapInArrow(each_gram, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    got = grams.withColumn("place", place).where(F.col("place") <= max_nodes).select("lang", "gram", "n").toArrow()
    names = got.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    index = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if langs else np.zeros(0, np.int64)
    key, at = np.unique(got.column("gram").to_numpy(), return_inverse=True)
    counts = np.zeros((len(key), len(langs)))
    np.add.at(counts, (at, index), got.column("n").to_numpy())
    return Model(langs, key.astype(np.uint32), counts)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte (of the best language). Null text, or text without a letter: `und`, score 0.

    Equal code lengths go to the language first in name order. Very long texts are read whole. No rows: no rows. Columns of docs with those three names are replaced; nothing
    but the text is read for a prediction.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "bits_per_byte")]
    body = fresh("body", docs)
    ready = docs.select(*kept, F.when(F.col(text).cast("string").rlike(r"\p{L}"), F.col(text).cast("string")).alias(body))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [UNKNOWN, *model.langs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for piece in textkit.chunks(batch, body):
                t = piece.column(body)
                buf, off = textkit.raw(t)
                known = ~t.is_null().to_numpy(zero_copy_only=False)
                best, score, per = np.zeros(len(t), np.int64), np.zeros(len(t)), np.full(len(t), np.nan)
                if m.langs and known.any():
                    bits = m.bits(buf, off)
                    size = np.maximum(np.diff(off), 1)
                    pick = bits.argmin(1)
                    least = bits.min(1)
                    share = np.exp2(-(bits - least[:, None]) * np.minimum(1, EVIDENCE_BYTES / size)[:, None])
                    best[known] = pick[known] + 1
                    score[known] = (1 / share.sum(1))[known]
                    per[known] = (least / size)[known]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in kept), pa.array([names[i] for i in best.tolist()]), pa.array(score), pa.array(per, mask=~known | np.isnan(per))],
                    names=[*kept, "lang_pred", "score", "bits_per_byte"],
                )

    fields = ready.drop(body).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return ready.mapInArrow(run, fields)
