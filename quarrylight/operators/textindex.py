"""A stored inverted index with positions and field weights: built once, kept up by documents, searched without the texts.

The index is a table of a `Store`. A row holds, for a term and a document, how often each field has it and where; rows are laid
down in buckets of terms, so a search opens the buckets of its terms alone. A document's lengths stand in a bucket of their own.
An update appends the rows of changed documents under a new version, and a removed document only its mark; a search takes a
document's newest version. `compact` writes the live rows anew.

Positions count all words of a field, those that are not indexed too, so phrases keep their gaps. Ids must be unique and not
null. Null texts are empty; an index without documents finds nothing. Rows of a term are dealt to SLICES by document, so a
frequent term is not one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions import text as words
from quarrylight.operators.lexical import K1, B, ranked
from quarrylight.session import written
from quarrylight.sources.store import Store

BUCKETS = 64
SLICES = 8
#: Words that a task turns into rows at once; their places, order and terms take some fifty bytes each.
WORDS = 1 << 18
#: Bucket of the documents' own rows.
LENGTHS = -1
#: A place is its field's number times this and the position in the field.
FIELD = 1 << 40


def _postings(n_fields: int, shortest: int):
    """Rows of a batch of (doc_id, words of each field)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(words.STOP_WORDS)
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            terms, docs, places = [], [], []
            lengths = np.zeros((batch.num_rows, n_fields), np.int64)
            for f in range(n_fields):
                column = batch.column(1 + f)
                off = column.offsets.to_numpy().astype(np.int64)
                flat = column.values.slice(off[0], off[-1] - off[0])
                off = off - off[0]
                kept = np.flatnonzero(pc.and_(pc.greater_equal(pc.binary_length(flat), shortest), pc.invert(pc.is_in(flat, stop))).to_numpy(zero_copy_only=False))
                doc = np.searchsorted(off, kept, "right") - 1
                terms.append(flat.take(pa.array(kept)))
                docs.append(doc)
                places.append(kept - off[doc] + f * FIELD)
                lengths[:, f] = np.bincount(doc, minlength=batch.num_rows)
            ids = batch.column(0)
            yield _rows(pa.nulls(0, pa.string()), ids, np.arange(batch.num_rows), lengths, np.zeros(batch.num_rows + 1, np.int64), np.zeros(0, np.int64))
            coded = pa.concat_arrays([t.cast(pa.string()) for t in terms]).dictionary_encode()
            code, doc, place = coded.indices.to_numpy().astype(np.int64), np.concatenate(docs), np.concatenate(places)
            order = np.lexsort((place, doc, code))
            code, doc, place = code[order], doc[order], place[order]
            head = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.zeros(0, np.int64)
            if len(head):
                each = np.stack([np.add.reduceat(place // FIELD == f, head, dtype=np.int64) for f in range(n_fields)], 1)
                yield _rows(coded.dictionary.take(pa.array(code[head])), ids, doc[head], each, np.r_[head, len(code)], place)

    return run


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about WORDS words, or one document with more."""
    if not batch.num_rows:
        return
    size = sum(pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
    cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // WORDS)) + 1
    for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, batch.num_rows].tolist(), strict=True):
        yield batch.slice(a, b - a)


def _rows(terms: pa.Array, ids: pa.Array, doc: np.ndarray, counts: np.ndarray, first: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    n = counts.shape[1]
    return pa.record_batch(
        [terms if len(terms) else pa.array([""] * len(doc)), ids.take(pa.array(doc)), pa.ListArray.from_arrays(pa.array((np.arange(len(doc) + 1) * n).astype(np.int32)), pa.array(counts.ravel().astype(np.int32))), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(places))],
        names=["term", "doc_id", "counts", "places"],
    )


class TextIndex:
    def __init__(self, store: Store, fields: dict[str, float], shortest: int = 3, name: str = "postings"):
        """fields: weight of each field in `match`; terms have `shortest` letters or more and are no stop words."""
        self.store, self.fields, self.shortest, self.name = store, fields, shortest, name

    # keeping it up

    def build(self, docs: DataFrame, fields: dict[str, Column], doc_id: str = "doc_id") -> int:
        """Indexes docs in place of what the index held."""
        staged = self.store.stage({self.name: self._laid(self._of(docs, fields, doc_id))}, partition_by={self.name: "bucket"})
        return self._published(staged)

    def update(self, changed: DataFrame, fields: dict[str, Column], removed: DataFrame | None = None, doc_id: str = "doc_id") -> int:
        """Puts changed documents, new ones too, in the place of their earlier versions and takes removed ids out."""
        rows = self._of(changed, fields, doc_id)
        if removed is not None:
            none = F.array(*[F.lit(0)] * len(self.fields))
            marks = removed.select(F.lit("").alias("term"), F.col(doc_id).alias("doc_id"), none.alias("counts"), F.array().cast("array<long>").alias("places"), F.lit(True).alias("gone"))
            rows = rows.unionByName(marks)
        return self._published(self.store.stage({}, append={self.name: self._laid(rows)}, partition_by={self.name: "bucket"}))

    def compact(self) -> int:
        """The live rows in one part."""
        rows = self._live(self._all()).drop("version", "bucket")
        return self.store.publish(self.store.stage({self.name: self._laid(rows)}, partition_by={self.name: "bucket"}))

    def _of(self, docs: DataFrame, fields: dict[str, Column], doc_id: str) -> DataFrame:
        runs = lambda c: F.regexp_extract_all(words.fold(F.coalesce(c.cast("string"), F.lit(""))), F.lit("[a-z0-9]+"), 0)
        ready = docs.select(F.col(doc_id).alias("doc_id"), *[runs(fields[f]).alias(f"f{i}") for i, f in enumerate(self.fields)])
        kind = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", ready.schema["doc_id"].dataType), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.LongType()))])
        return ready.mapInArrow(_postings(len(self.fields), self.shortest), kind).withColumn("gone", F.lit(False))

    def _laid(self, rows: DataFrame) -> DataFrame:
        bucket = F.when(F.col("term") == "", LENGTHS).otherwise(F.pmod(F.hash("term"), F.lit(BUCKETS)))
        out = rows.select("*", F.lit(self.store.generation() + 1).alias("version"), bucket.alias("bucket"))
        return out.repartition("bucket", F.pmod(F.hash("doc_id"), F.lit(SLICES)))

    def _published(self, staged) -> int:
        part = self.store.spark.read.parquet(f"{self.store.folder}/data/{staged.written[-1]}").where(F.col("bucket") == LENGTHS)
        if bad := part.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(3).collect():
            self.store.discard(staged)
            raise ValueError(f"ids are null or repeated: {[r['doc_id'] for r in bad]}")
        return self.store.publish(staged)

    # reading it

    def _parts(self) -> list[str]:
        return self.store.manifest()["tables"][self.name]

    def _all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.store.spark.read.parquet(f"{self.store.folder}/data/{p}") for p in self._parts()])

    def documents(self) -> DataFrame:
        """(doc_id, version, lengths) of the live documents; lengths: indexed words of each field."""
        own = self._all().where(F.col("bucket") == LENGTHS)
        newest = own.groupBy("doc_id").agg(F.max(F.struct("version", "gone", F.col("counts").alias("lengths"))).alias("d")).select("doc_id", "d.*")
        return newest.where("not gone").select("doc_id", "version", "lengths")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of documents' newest versions. One part alone has nothing old."""
        return rows if len(self._parts()) == 1 else rows.join(self.documents().select("doc_id", "version"), ["doc_id", "version"], "left_semi")

    def hits(self, terms: DataFrame) -> DataFrame:
        """(term, doc_id, counts, places) of the terms in a one-column frame. It reads the terms' buckets."""
        wanted = written(terms.toDF("term").where("term is not null").distinct(), "terms")
        buckets = [r[0] for r in wanted.select(F.pmod(F.hash("term"), F.lit(BUCKETS))).distinct().collect()]  # BUCKETS numbers at most
        found = self._all().where(F.col("bucket").isin(buckets)).join(wanted, "term", "left_semi")
        return self._live(found).select("term", "doc_id", "counts", "places")

    def asked(self, queries: DataFrame, text: str = "text", query_id: str = "item_id") -> DataFrame:
        """(query_id, term, at): the indexed words of each query and their positions."""
        runs = F.regexp_extract_all(words.fold(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit("[a-z0-9]+"), 0)
        each = queries.where(F.col(query_id).isNotNull()).select(query_id, F.posexplode(runs).alias("at", "term"))
        return written(each.where((F.length("term") >= self.shortest) & ~F.col("term").isin(*words.STOP_WORDS)), "asked")

    def match(self, queries: DataFrame, how: str = "or", text: str = "text", query_id: str = "item_id") -> DataFrame:
        """(query_id, doc_id, n_terms, score): documents with any (`or`) or every (`and`) term of a query, or with all its terms
        in their order and distance in one field (`phrase`). score: for each term the largest weight of a field that has it."""
        if how not in ("or", "and", "phrase"):
            raise ValueError(how)
        asked = self.asked(queries, text, query_id)
        size = asked.groupBy(query_id).agg(F.count_distinct("term").alias("n_query"), F.count("*").alias("n_places"))
        weight = F.array_max(F.array(*[F.when(F.col("counts")[i] > 0, F.lit(float(w))) for i, w in enumerate(self.fields.values())]))
        hits = self.hits(asked.select("term")).withColumn("weight", weight)
        both = hits.join(asked.groupBy(query_id, "term").agg(F.collect_list("at").alias("ats")), "term")
        scored = both.groupBy(query_id, "doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("score"))
        if how == "or":
            return scored
        whole = scored.join(size, query_id).where("n_terms = n_query")
        if how == "phrase":
            near = both.join(whole.select(query_id, "doc_id"), [query_id, "doc_id"], "left_semi")
            begun = near.select(query_id, "doc_id", "places", F.explode("ats").alias("at")).select(query_id, "doc_id", "at", F.explode("places").alias("place"))
            runs = begun.groupBy(query_id, "doc_id", (F.col("place") - F.col("at")).alias("begin"), F.floor(F.col("place") / FIELD).alias("field")).agg(F.count_distinct("at").alias("n_at"))
            found = runs.join(size, query_id).where("n_at = n_places").select(query_id, "doc_id").distinct()
            whole = whole.join(found, [query_id, "doc_id"], "left_semi")
        return whole.select(query_id, "doc_id", "n_terms", "score")

    def report(self, queries: DataFrame, hows: tuple[str, ...] = ("and", "or", "phrase"), k: int = 10, text: str = "text", query_id: str = "item_id") -> DataFrame:
        """(query_id, how, what, doc_id, val): the number of matches of each query and way (`total`, 0 too), and the place of the
        k best (`place`; by score, then id)."""
        every, out = queries.where(F.col(query_id).isNotNull()).select(query_id).distinct(), []
        for how in hows:
            found = written(self.match(queries, how, text, query_id), "matches")
            total = every.join(found.groupBy(query_id).agg(F.count("*").alias("n")), query_id, "left")
            out.append(total.select(query_id, F.lit(how).alias("how"), F.lit("total").alias("what"), F.lit(None).cast(found.schema["doc_id"].dataType).alias("doc_id"), F.coalesce("n", F.lit(0)).cast("long").alias("val")))
            out.append(ranked(found, query_id, "score", "doc_id", k).select(query_id, F.lit(how), F.lit("place"), "doc_id", F.col("rank").cast("long")))
        return reduce(DataFrame.union, out)

    def bm25(self, queries: DataFrame, times: dict[str, int], k: int = 10, text: str = "text", query_id: str = "item_id", distinct_terms: bool = True) -> DataFrame:
        """(query_id, doc_id, score, rank): Okapi BM25 as `lexical.bm25`; times: how often a field's words count."""
        factor = [int(times.get(f, 0)) for f in self.fields]
        summed = lambda c: reduce(lambda a, b: a + b, [F.col(c)[i] * n for i, n in enumerate(factor)])
        lengths = self.documents().select("doc_id", summed("lengths").alias("n"))
        facts = lengths.agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"))
        asked = self.asked(queries, text, query_id).groupBy(query_id, "term").agg(F.count("*").alias("n_asked"))
        tf = written(self.hits(asked.select("term")).select("term", "doc_id", summed("counts").alias("tf")).where("tf > 0"), "hits")
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("avg_len")))
        weighed = asked.join(df, "term").crossJoin(F.broadcast(facts)).select(query_id, "term", (idf * (F.lit(1) if distinct_terms else F.col("n_asked"))).alias("idf"), "avg_len")  # facts: one row
        scored = tf.join(lengths, "doc_id").join(weighed, "term").groupBy(query_id, "doc_id").agg(F.round(F.sum(F.col("idf") * gain), 6).alias("score"))
        return ranked(scored, query_id, "score", "doc_id", k)
