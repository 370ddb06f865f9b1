"""Mentions of a catalogue's models in whole texts, by one automaton for all models.

A model is read as a run of segments, letters or digits; between two segments a text may have any run of separators, or none:
`MS-5210UD` is also `ms 5210 ud` and `ms5210ud`. A mention begins where a word begins and has no digit behind it. Of several
models that begin at the same place the one with the longest pattern wins, and the next mention begins behind it.

The models without separators are the words of a trie with failure links; it runs once over the text without separators, and
each hit is then held against the places where separators stood. So a text costs its length and its hits, however many models
there are. The models of a block are sent to the executors; a catalogue of more than BLOCK models is read block by block, and
the hits of all blocks are settled at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.session import fresh, written

#: Separators that may stand between segments, and those of them that a model's key leaves out. Fixed values.
SEPARATORS = "-/.+ \t\n\x0b\f\r"
KEY_GAPS = r"[-/ \t\n\x0b\f\r]+"
#: What a gap adds to the length by which patterns are ranked (that of the gap as a regular expression). Fixed value.
GAP_LENGTH = 11
#: Models in an automaton.
BLOCK = 200_000
MOST_BYTES = 64 << 20

_GAP = np.zeros(256, bool)
_GAP[list(SEPARATORS.encode())] = True
_HIT = "array<struct<start: int, end: int, length: int, model: string>>"


def key(model: Column) -> Column:
    """What two spellings of a model share."""
    return F.regexp_replace(T.fold(model), KEY_GAPS, "")


def base_alias(model: Column) -> Column:
    """The family of a model of three parts or more with a digit before the last: `CAD-150` of `CAD-150-8`; else null."""
    parts = F.filter(F.split(model, KEY_GAPS), lambda p: p != "")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "-")
    return F.when((F.size(parts) >= 3) & base.rlike("[0-9]"), base)


def entries(models: Column, catalogue: DataFrame) -> DataFrame:
    """(pattern, alias, key, model): the folded models and family names of a catalogue, one row for each pattern, with the model
    that its key stands for: a model before a family name, then the least name."""
    own = catalogue.select(models.cast("string").alias("name")).where("name is not null").distinct()
    both = own.select("name", F.lit(0).alias("alias")).union(own.select(base_alias(F.col("name")), F.lit(1)).where(F.col("name").isNotNull()))
    keyed = both.select(T.fold(F.col("name")).alias("pattern"), "alias", key(F.col("name")).alias("key"), "name")
    first = keyed.groupBy("key").agg(F.min(F.struct("alias", "name")).alias("first"))
    return keyed.groupBy("pattern", "key").agg(F.min("alias").alias("alias")).join(first, "key").where("pattern rlike '[a-z0-9]'").select("pattern", "alias", "key", F.col("first.name").alias("model"))


class Automaton:
    """Finds every place where a pattern may be read, settled or not."""

    def __init__(self, patterns: Iterable[tuple[str, str]]):
        """patterns: folded pattern and model of the key."""
        import ahocorasick

        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.shapes: list[list[tuple[int, frozenset[int]]]] = []
        self.models = {}
        for pattern, model in patterns:
            segments = re.findall("[a-z]+|[0-9]+", pattern)
            word = "".join(segments)
            if not word:
                continue
            self.models[re.sub(KEY_GAPS, "", pattern)] = model
            cuts = frozenset(np.cumsum([len(s) for s in segments])[:-1].tolist())
            shape = len(word) + GAP_LENGTH * (len(segments) - 1), cuts
            at = self.auto.get(word, None)
            if at is None:
                self.auto.add_word(word, len(self.shapes))
                self.shapes.append([shape])
            elif shape not in self.shapes[at]:
                self.shapes[at].append(shape)
        self.sizes = {}
        if self.shapes:
            self.sizes = {i: len(w) for w, i in self.auto.items()}
            self.auto.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, str | None]]:
        """(start, end, pattern length, model or None) of every reading in a folded text."""
        if not self.shapes or not text:
            return []
        signs = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        place = np.flatnonzero(~_GAP[signs])
        out = []
        for last, i in self.auto.iter(signs[place].tobytes().decode()):
            first = last - self.sizes[i] + 1
            start, end = int(place[first]), int(place[last]) + 1
            if start and (text[start - 1].isalnum() or text[start - 1] == "_") or end < len(text) and text[end] in "0123456789":
                continue
            gaps = np.flatnonzero(np.diff(place[first : last + 1]) > 1) + 1
            fits = [length for length, cuts in self.shapes[i] if all(int(g) in cuts for g in gaps)]
            if fits:
                out.append((start, end, max(fits), self.models.get(re.sub(KEY_GAPS, "", text[start:end]))))
        return out


def settle(hits: list[tuple[int, int, int, str | None]]) -> list[tuple[int, int, str]]:
    """Mentions (start, end, model): leftmost first, of those the longest pattern, none within another. A reading that is no
    model's key (it has a separator that keys keep) takes its place without being a mention."""
    out, free = [], 0
    for start, end, _, model in sorted(hits, key=lambda h: (h[0], -h[2], h[1])):
        if start >= free:
            free = end
            if model is not None:
                out.append((start, end, model))
    return out


@lru_cache(2)
def _automaton(patterns: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(patterns)


def find(docs: DataFrame, catalogue: DataFrame, model: str, text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with `mentions`: array of (start, end, model) in order, places in the folded text. Null text: none. An empty
    catalogue: none. A column of that name is replaced."""
    spark = docs.sparkSession
    body, hits = fresh("body", docs), fresh("hits", docs)
    kept = [c for c in docs.columns if c.lower() != "mentions"]
    known = written(entries(F.col(model), catalogue), "patterns")
    n_blocks = max(1, -(-known.count() // block))
    now = docs.select(*kept, T.fold(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias(body), F.array().cast(_HIT).alias(hits))
    for i in range(n_blocks):
        part = known.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == i)
        size = part.agg(F.sum(F.octet_length("pattern") + F.octet_length("model"))).first()[0] or 0
        if size > MOST_BYTES:
            raise ValueError(f"a block of the catalogue has {size} bytes; call find with a smaller block")
        sent = spark.sparkContext.broadcast(tuple(sorted((r["pattern"], r["model"]) for r in part.select("pattern", "model").collect())))
        last = i + 1 == n_blocks
        now = now.mapInArrow(_step(sent, body, hits, last), now.drop(*([body] if last else [])).schema)
        if not last:
            now = written(now, "hits")
    return now.select(*kept, F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["model"].alias("model"))).alias("mentions"))


def _step(sent, body: str, hits: str, last: bool):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length", pa.int32()), ("model", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value)
        for batch in batches:
            out = []
            for text, before in zip(batch.column(body), batch.column(hits), strict=True):
                found = [tuple(h.values()) for h in before.as_py()] + automaton.hits(text.as_py())
                if last:
                    found = [(a, z, 0, m) for a, z, m in settle(found)]
                out.append([{"start": a, "end": z, "length": n, "model": m} for a, z, n, m in found])
            names = [c for c in batch.schema.names if not (last and c == body)]
            yield pa.record_batch([pa.array(out, kind) if c == hits else batch.column(c) for c in names], names=names)

    return run


def by_document(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, model, place, n): each model of a document once, in order of first mention."""
    each = found.select(doc_id, F.posexplode("mentions").alias("p", "m")).groupBy(doc_id, F.col("m.model").alias("model")).agg(F.min("p").alias("first"), F.count("*").alias("n"))
    listed = each.groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct("first", "model", "n"))).alias("all"))  # the models of one document
    return listed.select(doc_id, F.posexplode("all").alias("place", "m")).select(doc_id, F.col("m.model").alias("model"), (F.col("place") + 1).alias("place"), F.col("m.n").alias("n"))
