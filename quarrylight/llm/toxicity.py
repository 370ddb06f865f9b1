"""Toxicity by a convolutional text classifier, trained on every labelled text by replicas that Spark averages.

A word's vector is the sum of the rows of a hashed table for the word and for its first 4, 5 and 6 bytes. Filters of one, two
and three words slide over the whole text; each keeps its largest value after a rectifier, and a logistic unit weighs these.
The first coordinate of the table begins at the log-odds of a word among toxic and other training texts, the rest at random;
training (Adam on the cross entropy) then moves table, filters and unit. Gradients reach only the windows that gave a filter's
largest value.

Thresholds are calibrated by language on training rows that the gradient steps did not see. The language is told from the
words of the text alone, by a naive Bayes model over the same hashes that the training rows' `lang` teaches; a language with
few calibration rows leans on the threshold of all. A score is the logistic of how far a text lies over the threshold of its
language, so 0.5 is the decision everywhere.

Training (`fit`) reads every whole labelled text. Its terms are hashed once, and its rows dealt by id to replicas of about
REPLICA_ROWS rows, one a task; three of four rows are for the gradient steps, the fourth for the thresholds. In each of EPOCHS
rounds a replica begins with the common parameters and takes its steps over all of its rows; Spark adds up how far each
row of parameters moved, weighted by the steps that moved it, and the mean is the next round's beginning. Sums are of integers, so
they don't depend on the order of tasks. What reaches the driver is of fixed size: counts for each row of the table and
language, one set of parameters a round, and counts of calibration rows by language and logit, in steps of 1 / GRAIN.
Every whole text is scored, in steps of bounded size.

`sample` and `train` fit the same classifier to a bounded sample on the driver, for trials; no query uses them.

Null and empty texts, and texts without a term, get the score of no windows at all. Rows that repeat a doc_id are scored each
on its own; equal texts have equal scores. No labelled rows, or of one class only: a model that gives every text the share of
toxic rows it saw (0 if none). No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import terms as words
from quarrylight.llm import textkit
from quarrylight.llm.common import broadcast_if_small, fresh, written

#: Labelled rows of a replica, about.
REPLICA_ROWS = 4_000
#: Steps of a logit in the counts that thresholds are found from.
GRAIN = 1024
#: Parts of a unit in which the replicas' moves are added up.
MOVE = 1 << 32
#: Bounds of the sample for trials.
TRAIN_ROWS = 4_000
TRAIN_BYTES = 20_000
MARGIN = 1.5
ROWS_BITS = 16
WIDE = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (4, 5, 6)
EPOCHS = 6
BATCH = 32
RATE = 0.01
#: Calibration rows of a language whose own threshold weighs as much as that of all.
LEAN = 5
#: What a clean text taken for toxic costs against a toxic one missed.
CLEAN = 2
#: Terms scored at once.
STEP = 1 << 18


def features(t: words.Terms) -> np.ndarray:
    """Rows of the table for each term: of the term and of its beginnings."""
    shift = np.uint64(64 - ROWS_BITS)
    return np.stack([(textkit.mix(t.hashes(p) + np.uint64(i)) >> shift).astype(np.int32) for i, p in enumerate((None, *PREFIXES))], 1)


def _pools(x: np.ndarray, first: np.ndarray, filters: list[np.ndarray], bias: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each filter in each text, and the place of the window that has it (-1: none over 0)."""
    n = len(first) - 1
    top, place = np.zeros((n, len(filters) * FILTERS), np.float32), np.full((n, len(filters) * FILTERS), -1, np.int64)
    length = np.diff(first)
    for k, (w, b) in enumerate(zip(filters, bias, strict=True)):
        wide = WIDTHS[k]
        if len(x) < wide:
            continue
        z = b + sum(x[j : len(x) - wide + 1 + j] @ w[j] for j in range(wide))
        full = np.flatnonzero(length >= wide)
        if not len(full):
            continue
        inside = np.ones(len(z), bool)
        for j in range(1, wide):  # windows that run into the next text
            at = first[1:] - j
            inside[at[(at >= 0) & (at < len(z))]] = False
        z[~inside] = 0
        np.maximum(z, 0, out=z)
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        most = np.maximum.reduceat(z, first[:-1][full], axis=0)
        top[full, own] = most
        for c in range(FILTERS):
            hit = np.flatnonzero((z[:, c] == np.repeat(_spread(most[:, c], full, n), length)[: len(z)]) & (z[:, c] > 0))
            text = np.searchsorted(first, hit, "right") - 1
            place[text[::-1], k * FILTERS + c] = hit[::-1]
    return top, place


def _spread(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, values.dtype)
    out[at] = values
    return out


@dataclass
class Model:
    langs: list[str]
    lang_table: np.ndarray  # log share of each hash in each language
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    unit: np.ndarray
    offset: float
    thresholds: np.ndarray  # of each language, then of all
    sharpness: float
    flat: float | None = None  # the score of every text where nothing could be learned

    def pooled(self, t: words.Terms) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the largest filter values, and the language as a number (that of `all` for texts without terms)."""
        return self.pooled_features(features(t), t.first)

    def pooled_features(self, feature: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(first) - 1
        top, tongue = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.zeros((n, len(self.langs)))
        for a in range(0, len(feature), STEP):
            part = np.clip(first - a, 0, min(STEP, len(feature) - a))
            if self.langs:
                some = np.flatnonzero(np.diff(part))
                tongue[some] += np.add.reduceat(self.lang_table[feature[a : a + STEP, 0]], part[some], axis=0)
            over = np.clip(first - a, 0, min(STEP + max(WIDTHS) - 1, len(feature) - a))  # windows that begin in the step
            x = sum(self.table[f] for f in feature[a : a + STEP + max(WIDTHS) - 1].T)
            for k in range(len(WIDTHS)):
                z = self._windows(x, over, k)
                some = np.flatnonzero(np.diff(over))
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                top[some, own] = np.maximum(top[some, own], np.maximum.reduceat(z, over[some], axis=0))
        lang = tongue.argmax(1) if self.langs else np.zeros(n, np.int64)
        lang[np.diff(first) == 0] = len(self.langs)
        return top, lang

    def _windows(self, x: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
        """A filter's values, one for each term; 0 where its window runs out of the text."""
        wide, n = WIDTHS[k], len(x)
        z = np.zeros((n, FILTERS), np.float32)
        if n >= wide:
            z[: n - wide + 1] = self.bias[k] + sum(x[j : n - wide + 1 + j] @ self.filters[k][j] for j in range(wide))
            for j in range(1, wide):
                at = first[1:] - j
                z[at[at >= 0]] = 0
        return np.maximum(z, 0, out=z)

    def raw(self, feature: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top, lang = self.pooled_features(feature, first)
        return top @ self.unit + self.offset, lang

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(texts), self.flat)
        t = words.terms(texts, words.LETTERS_AND_DIGITS)
        z, lang = self.raw(features(t), t.first)
        return 1 / (1 + np.exp(-np.clip(self.sharpness * (z - self.thresholds[lang]), -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", toxic: str = "toxic", rows: int = TRAIN_ROWS) -> pa.Table:
    """(text, lang, toxic): labelled texts of at most TRAIN_BYTES, up to rows / 2 of each class, by hash of the id. The ids are
    drawn from the labels before any text is read, with a margin for texts that are too long. An id with several labels takes
    the largest, one with several texts the least; null ids and labels are left out."""
    marked = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    half, place = rows // 2, F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    below = {c: int(min(1.0, MARGIN * half / x) * (1 << 32)) for c, x in n.items()}
    lot = marked.where((F.col("toxic") == 0) & (place < below.get(0, 0)) | (F.col("toxic") == 1) & (place < below.get(1, 0)))
    body = F.col(text).cast("string")
    own = docs.select(F.col(doc_id).alias("id"), body.alias("text"), F.col(lang).cast("string").alias("lang")).where(F.octet_length("text").between(1, TRAIN_BYTES))
    found = own.join(broadcast_if_small(written(lot, "lot")), "id").groupBy("id", "toxic").agg(F.min(F.struct("text", "lang")).alias("one"))
    each = [found.where(F.col("toxic") == c).orderBy(place, "id").limit(half) for c in (0, 1)]
    return each[0].union(each[1]).select("one.text", "one.lang", "toxic").toArrow()


def _parts(flat: np.ndarray) -> list[np.ndarray]:
    """Table, filters, biases, unit and offset as views of all parameters, rows of WIDE numbers each."""
    rest, out, at = flat[1 << ROWS_BITS :].reshape(-1), [flat[: 1 << ROWS_BITS]], 0
    for shape in (*((w, WIDE, FILTERS) for w in WIDTHS), *((FILTERS,) for _ in WIDTHS), (len(WIDTHS) * FILTERS,), (1,)):
        n = int(np.prod(shape))
        out.append(rest[at : at + n].reshape(shape))
        at += n
    return out


REST = -(-(sum(WIDTHS) * WIDE * FILTERS + 2 * len(WIDTHS) * FILTERS + 1) // WIDE)  # rows after the table


def _beginning(seen: np.ndarray, n_clean: int, n_toxic: int, seed: int) -> np.ndarray:
    """Parameters before the first step; seen: clean and toxic texts that have each row of the table."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(((1 << ROWS_BITS) + REST, WIDE), np.float32)
    parts = _parts(flat)
    parts[0][:] = rng.normal(0, 0.05, parts[0].shape)
    odds = np.log((seen[1] + 0.5) / (n_toxic + 1)) - np.log((seen[0] + 0.5) / (n_clean + 1))
    parts[0][:, 0] = 0.25 * odds * (seen.sum(0) / (seen.sum(0) + 5))
    for f in parts[1 : 1 + len(WIDTHS)]:
        f[:] = rng.normal(0, 0.3, f.shape)
        f[:, 0] = np.abs(f[:, 0]) + 0.5 / len(f)
    parts[-2][:] = 0.1
    return flat


def _model(flat: np.ndarray, langs: list[str], lang_table: np.ndarray) -> Model:
    table, *rest = _parts(flat)
    return Model(langs, lang_table, table, rest[: len(WIDTHS)], rest[len(WIDTHS) : -2], rest[-2], float(rest[-1][0]), np.zeros(len(langs) + 1), 1.0)


def _flat_model(share: float) -> Model:
    return Model([], np.zeros((0, 0)), np.zeros((0, 0)), [], [], np.zeros(0), 0.0, np.zeros(1), 1.0, flat=share)


def _lang_table(counts: list[np.ndarray]) -> np.ndarray:
    """Log share of each row of the table in each language."""
    out = np.zeros((1 << ROWS_BITS, len(counts)), np.float32)
    for i, n in enumerate(counts):
        out[:, i] = np.log((n + 0.1) / (n.sum() + 0.1 * (1 << ROWS_BITS)))
    return out


def _seen(feature: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the texts have each row of the table, added up over the word and its beginnings."""
    owner, out = np.repeat(np.arange(len(first) - 1), np.diff(first)), np.zeros(1 << ROWS_BITS, np.int64)
    for f in feature.T:
        out += np.bincount(np.unique((owner << ROWS_BITS) + f) & ((1 << ROWS_BITS) - 1), minlength=1 << ROWS_BITS)
    return out


def _cut(feature: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of some of the texts, and where each begins."""
    size = np.diff(first)[some]
    at = np.repeat(first[:-1][some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return feature[at], np.r_[0, np.cumsum(size)]


def _largest(table: np.ndarray, filters: list[np.ndarray], bias: list[np.ndarray], feature: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_pools` of texts of any length, STEP terms at once."""
    shape = (len(first) - 1, len(WIDTHS) * FILTERS)
    top, place = np.zeros(shape, np.float32), np.full(shape, -1, np.int64)
    for a in range(0, len(feature), STEP):
        over = np.clip(first - a, 0, min(STEP + max(WIDTHS) - 1, len(feature) - a))
        t, at = _pools(sum(table[f] for f in feature[a : a + STEP + max(WIDTHS) - 1].T), over, filters, bias)
        better = t > top
        top[better], place[better] = t[better], at[better] + a
    return top, place


def _learn(flat: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], weight: tuple[float, float]) -> np.ndarray:
    """Moves the parameters by a step for each batch of (features, first, toxic); weight: of a clean and of a toxic row. Returns
    how many steps moved each row of parameters."""
    params, moved = _parts(flat), np.zeros(len(flat), np.int64)
    table, filters, bias, unit, offset = params[0], params[1 : 1 + len(WIDTHS)], params[1 + len(WIDTHS) : -2], params[-2], params[-1]
    first_moment, second_moment = _parts(np.zeros_like(flat)), _parts(np.zeros_like(flat))
    usual = 0

    def move(i: int, grad: np.ndarray, at=slice(None)) -> None:
        first_moment[i][at] = 0.9 * first_moment[i][at] + 0.1 * grad
        second_moment[i][at] = 0.99 * second_moment[i][at] + 0.01 * grad * grad
        params[i][at] -= RATE * (first_moment[i][at] / (1 - 0.9**usual)) / (np.sqrt(second_moment[i][at] / (1 - 0.99**usual)) + 1e-6)

    for f, first, y in batches:
        usual += 1
        top, place = _largest(table, filters, bias, f, first)
        p = 1 / (1 + np.exp(-(top @ unit + offset)))
        error = ((p - y) * np.where(y == 1, weight[1], weight[0]) / len(y)).astype(np.float32)
        flow = error[:, None] * unit[None, :]
        grads = [top.T @ error, np.array([error.sum()], np.float32)]
        touched, change = [], []
        for k, wide in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            text, c = np.nonzero(place[:, own] >= 0)
            start, g = place[:, own][text, c], flow[:, own][text, c]
            grad_w, grad_b = np.zeros_like(filters[k]), np.bincount(c, g, FILTERS).astype(np.float32)
            for j in range(wide):
                x = sum(table[r] for r in f[start + j].T)
                np.add.at(grad_w[j].T, c, g[:, None] * x)
                touched.append(f[start + j].ravel())
                change.append(np.repeat(g[:, None] * filters[k][j][:, c].T, f.shape[1], axis=0))
            move(1 + k, grad_w)
            move(1 + len(WIDTHS) + k, grad_b)
        rows_of, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        if len(rows_of):
            grad = np.zeros((len(rows_of), WIDE), np.float32)
            np.add.at(grad, inverse, np.concatenate(change))
            move(0, grad, rows_of)
            moved[rows_of] += 1
        move(len(params) - 2, grads[0])
        move(len(params) - 1, grads[1])
    moved[1 << ROWS_BITS :] = usual
    return moved


def train(rows: pa.Table, seed: int = 12) -> Model:
    """Fits the classifier to a small table of (text, lang, toxic), here; every fourth row is kept for the thresholds."""
    rng = np.random.default_rng(seed)
    y = rows.column("toxic").to_numpy().astype(np.float64)
    if len(np.unique(y)) < 2:
        return _flat_model(float(y.mean()) if len(y) else 0.0)
    t = words.terms(rows.column("text").combine_chunks(), words.LETTERS_AND_DIGITS)
    feature, length = features(t), np.diff(t.first)
    order = rng.permutation(len(y))
    fit = np.ones(len(y), bool)
    for c in (0.0, 1.0):
        fit[order[y[order] == c][3::4]] = False
    named = rows.column("lang").to_pylist()
    langs = sorted({x for x, n in zip(named, length, strict=True) if x is not None and n})
    code = np.repeat(np.array([langs.index(x) if x in langs else -1 for x in named]), length)
    tongues = _lang_table([np.bincount(feature[code == i, 0], minlength=1 << ROWS_BITS) for i in range(len(langs))])
    n_clean, n_toxic = (fit & (y == 0)).sum(), (fit & (y == 1)).sum()
    flat = _beginning(np.stack([_seen(*_cut(feature, t.first, np.flatnonzero(fit & (y == c)))) for c in (0, 1)]), n_clean, n_toxic, seed)
    rows_in = np.flatnonzero(fit)

    def batches() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _ in range(EPOCHS):
            rng.shuffle(rows_in)
            for some in np.array_split(rows_in, -(-len(rows_in) // BATCH)):
                yield *_cut(feature, t.first, some), y[some]

    _learn(flat, batches(), tuple(0.5 * len(rows_in) / max(1, n) for n in (n_clean, n_toxic)))
    model = _model(flat, langs, tongues)
    z, lang = model.raw(feature, t.first)
    held = ~fit if len(np.unique(y[~fit])) == 2 else np.ones(len(y), bool)
    model.thresholds, model.sharpness = _thresholds(z[held], lang[held], y[held], 1 - y[held], len(langs))
    return model


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features and beginnings of the texts of a batch of hashed rows."""
    raw = batch.column("f").cast(pa.large_binary())
    off = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    wide = 1 + len(PREFIXES)
    feature = np.frombuffer(raw.buffers()[2], np.uint16, int(off[-1] - off[0]) // 2, int(off[0])) if off[-1] > off[0] else np.zeros(0, np.uint16)
    return feature.reshape(-1, wide).astype(np.int32), (off - off[0]) // (2 * wide)


def _hashed(rows: DataFrame) -> DataFrame:
    """(toxic, held, lang, f): `f` are the table's rows of each term, in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textkit.chunks(batch, "text", 1 << 20):
                t = words.terms(piece.column("text"), words.LETTERS_AND_DIGITS)
                f = np.ascontiguousarray(features(t).astype(np.uint16))
                ends = pa.py_buffer((t.first * f.shape[1] * 2).astype(np.int64))
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), piece.num_rows, [None, ends, pa.py_buffer(f)])
                yield pa.RecordBatch.from_arrays([piece.column("toxic"), piece.column("held"), piece.column("lang"), packed.cast(pa.binary())], names=["toxic", "held", "lang", "f"])

    return rows.select("text", "toxic", "held", "lang").mapInArrow(run, "toxic int, held boolean, lang string, f binary")


def _counted(rows: DataFrame) -> pa.Table:
    """(part, lang, row, n): part 0 the texts by class and use, row 2 * toxic + held; 1 and 2 the clean and toxic texts with
    each row of the table; 3 the terms of each row in a language."""

    def some(part: int, lang: str | None, n: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["part", "lang", "row", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, seen, tongue = np.zeros(4, np.int64), np.zeros((2, 1 << ROWS_BITS), np.int64), {}
        for batch in batches:
            for piece in textkit.chunks(batch, "f"):
                feature, first = _texts(piece)
                y, held = piece.column("toxic").to_numpy(), piece.column("held").to_numpy(zero_copy_only=False)
                use += np.bincount(2 * y + held, minlength=4)
                for c in (0, 1):
                    seen[c] += _seen(*_cut(feature, first, np.flatnonzero(~held & (y == c))))
                named = piece.column("lang").dictionary_encode()
                code = named.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for i, name in enumerate(named.dictionary.to_pylist()):
                    own = _cut(feature, first, np.flatnonzero(code == i))[0]
                    if len(own):
                        tongue[name] = tongue.get(name, 0) + np.bincount(own[:, 0], minlength=1 << ROWS_BITS)
                if len(tongue) > 64:
                    yield from (some(3, x, n) for x, n in tongue.items())
                    tongue = {}
        yield some(0, None, use)
        yield from (some(1 + c, None, seen[c]) for c in (0, 1))
        yield from (some(3, x, n) for x, n in tongue.items())

    return rows.mapInArrow(run, "part int, lang string, row int, n long").groupBy("part", "lang", "row").agg(F.sum("n").alias("n")).toArrow()


def _round(rows: DataFrame, flat: np.ndarray, weight: tuple[float, float], turn: int) -> np.ndarray:
    """The parameters after every replica took its steps from `flat`: the mean of the moves of each row of parameters."""
    sent = rows.sparkSession.sparkContext.broadcast(flat)
    names = ["row", "steps", *(f"d{i}" for i in range(WIDE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value.copy()
        rng = np.random.default_rng([turn, TaskContext.get().partitionId()])

        def each() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for piece in textkit.chunks(batch, "f", 16 << 20):
                    feature, first = _texts(piece)
                    y = piece.column("toxic").to_numpy().astype(np.float64)
                    order = rng.permutation(len(y))
                    for some in np.array_split(order, -(-len(y) // BATCH)):
                        yield *_cut(feature, first, some), y[some]

        steps = _learn(mine, each(), weight)
        at = np.flatnonzero(steps)
        far = np.rint((mine[at] - sent.value[at]).astype(np.float64) * steps[at, None] * MOVE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(steps[at]), *(pa.array(np.ascontiguousarray(c)) for c in far.T)], names=names)

    moves = rows.where("not held").select("toxic", "f").mapInArrow(run, "row int, " + ", ".join(f"{c} long" for c in names[1:]))
    got = moves.groupBy("row").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
    out = flat.copy()
    total = np.stack([got.column(c).to_numpy() for c in names[2:]], 1) / MOVE
    out[got.column("row").to_numpy()] += (total / got.column("steps").to_numpy()[:, None]).astype(np.float32)
    sent.unpersist()
    return out


def _logits(rows: DataFrame, model: Model) -> pa.Table:
    """(lang, z, toxic, clean): rows of each class by predicted language and logit in steps of 1 / GRAIN."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textkit.chunks(batch, "f", 16 << 20):
                z, lang = sent.value.raw(*_texts(piece))
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(np.rint(z * GRAIN).astype(np.int64)), piece.column("toxic")], names=["lang", "z", "toxic"])

    one = rows.select("toxic", "f").mapInArrow(run, "lang int, z long, toxic int")
    return one.groupBy("lang", "z").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).orderBy("lang", "z").toArrow()


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", toxic: str = "toxic", seed: int = 12) -> Model:
    """The classifier, trained on every text of docs that has a label and is not empty. An id with several labels takes the
    largest; rows that repeat an id are texts of their own; null ids and labels are left out."""
    marked = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = written(marked, "marked")
    replicas = max(1, -(-marked.count() // REPLICA_ROWS))
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(F.octet_length("text") > 0)
    place = F.xxhash64("id")
    lot = own.join(broadcast_if_small(marked), "id").withColumn("held", F.pmod(place, F.lit(4)) == 0)
    # a partition is a replica, its rows in an order of their own; kept so that each round reads the same
    rows = _hashed(lot.repartition(replicas, "id").sortWithinPartitions(place, "id", "text", "lang")).persist(StorageLevel.DISK_ONLY)
    try:
        counts = _counted(rows).to_pandas()
        use = counts[counts.part == 0].set_index("row").n
        n = [[int(use.get(2 * c + h, 0)) for h in (0, 1)] for c in (0, 1)]
        if not sum(n[0]) or not sum(n[1]):
            return _flat_model(1.0 if sum(n[1]) else 0.0)

        def dense(part: int, name: str | None = None) -> np.ndarray:
            own = counts[(counts.part == part) & ((counts.lang == name) if name is not None else True)]
            out = np.zeros(1 << ROWS_BITS, np.int64)
            out[own.row] = own.n
            return out

        langs = sorted(counts.lang[counts.part == 3].unique())
        tongues = _lang_table([dense(3, x) for x in langs])
        flat = _beginning(np.stack([dense(1), dense(2)]), n[0][0], n[1][0], seed)
        del counts
        weight = tuple(0.5 * (n[0][0] + n[1][0]) / max(1, n[c][0]) for c in (0, 1))
        for turn in range(EPOCHS):
            flat = _round(rows, flat, weight, turn)
        model = _model(flat, langs, tongues)
        found = _logits(rows.where("held") if n[0][1] and n[1][1] else rows, model)
        z, lang_of, bad, good = (found.column(c).to_numpy() for c in ("z", "lang", "toxic", "clean"))
        model.thresholds, model.sharpness = _thresholds(z / GRAIN, lang_of, bad, good, len(langs))
        return model
    finally:
        rows.unpersist()


def _thresholds(z: np.ndarray, lang: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_lang: int) -> tuple[np.ndarray, float]:
    """Of each language and of all: the logit that tells the classes apart best on the calibration rows: the least share of
    toxic rows missed plus CLEAN times the share of others taken for toxic, in the middle of the best gap. toxic, clean: how
    many rows of the class each entry of z stands for; both classes must occur."""

    def best(some: np.ndarray) -> float | None:
        if not toxic[some].sum() or not clean[some].sum():
            return None
        values, inverse = np.unique(z[some], return_inverse=True)
        bad = np.bincount(inverse, toxic[some], len(values)) / toxic[some].sum()
        good = np.bincount(inverse, clean[some], len(values)) / clean[some].sum()
        errors = np.r_[0, np.cumsum(bad)] + CLEAN * (1 - np.r_[0, np.cumsum(good)])  # of a threshold below each value, and above all
        edges = np.r_[values[0] - 1, (values[1:] + values[:-1]) / 2, values[-1] + 1]
        least = np.flatnonzero(errors <= errors.min() + 1e-12)
        return float(edges[least].mean()) if np.ptp(least) == len(least) - 1 else float(edges[least[len(least) // 2]])

    common = best(np.ones(len(z), bool))
    out = np.full(n_lang + 1, common)
    for i in range(n_lang):
        if (found := best(lang == i)) is not None:
            n = min(toxic[lang == i].sum(), clean[lang == i].sum())
            out[i] = (n * found + LEAN * common) / (n + LEAN)
    spread = np.abs(z - out[lang])
    order = np.argsort(spread, kind="stable")
    upto = np.cumsum((toxic + clean)[order])
    return out, float(2 / max(1e-3, spread[order][np.searchsorted(upto, upto[-1] / 2)]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on). Columns of docs with those names are replaced; nothing but the
    text is read for a score."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    body = fresh("body", docs)
    ready = docs.select(*kept, F.col(text).cast("string").alias(body))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size for each language of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for piece in textkit.chunks(batch, body, 1 << 20):
                p = m.scores(piece.column(body))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return ready.mapInArrow(run, ready.drop(body).schema.add("score", "double").add("predicted", "integer"))
