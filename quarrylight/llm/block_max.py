"""Ranked lexical search over an inverted index of compressed blocks with their largest impacts (Block-Max WAND).

`build` cuts the documents into shards, each made in one task from about SHARD_BYTES of text, and writes a row for each shard
and term: the term's postings in blocks of BLOCK documents, packed in as few whole bytes as the block's gaps and counts need,
and, readable without unpacking, each block's first and last document and its largest impact.

`search` brings the rows of the queries' terms to their shard. There the shallow move lays the block ends of all terms of a
query on one line: between two neighbouring ends every term stands in one known block or in none, so the sum of the blocks'
largest impacts bounds every document there. Runs whose bound is under the threshold are skipped and their blocks never
unpacked; the others are scored, those of the largest bounds first, and raise the threshold. The threshold of a query is its
k-th best score so far and goes on from shard to shard of a task. A run with the same score as the threshold is not skipped,
so ties are decided by id alone and the result is exact.

Scores are 64-bit integers: a posting's impact is (1000000000 * tf) div (1000 * tf + 12 * m), where m is 75 + (25 * n * N) div L
for a document of n terms, N documents with terms and L terms in all; a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))).

Rows without an id are left out. Null and empty texts have no terms and are never found. Rows that repeat an id are documents
of their own, also when they are equal. A text may have any length: a shard holds one document at least. No documents, or
queries without terms: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm import terms as words
from quarrylight.llm import textkit
from quarrylight.llm.common import broadcast_if_small, written

#: Postings in a block.
BLOCK = 64
#: Text that a shard is made from.
SHARD_BYTES = 8 << 20
#: Queries that are answered together in a shard.
ITEMS = 256
#: Rows in a batch of the index.
ROWS = 20_000
INDEX = "shard long, term string, n long, blocks binary, starts array<int>, firsts array<int>, lasts array<int>, tops array<int>"


@dataclass
class Index:
    table: DataFrame  # INDEX; the term '' holds ids and lengths of the shard's documents
    n_docs: int  # documents with a term
    n_terms: int  # of all documents, with repeats


def _widths(most: np.ndarray) -> np.ndarray:
    """Bytes that numbers up to `most` take; none for 0."""
    return (most > 0).astype(np.int64) + (most > 0xFF) + (most > 0xFFFF) + (most > 0xFFFFFF)


def pack(lists: np.ndarray, doc: np.ndarray, tf: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Bytes of all blocks, and of each block: list, start in the bytes, postings, first and last document, largest impact.

    A block: one byte with the widths of gaps (low four bits) and of counts, then all gaps (the first is 0), then all counts
    less one. lists: number of the list of each posting, ascending; doc ascends within a list."""
    n = len(lists)
    new = np.r_[True, lists[1:] != lists[:-1]]
    head = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(head, np.diff(np.r_[head, n]))
    at = np.flatnonzero(place % BLOCK == 0)
    size = np.diff(np.r_[at, n])
    block = np.repeat(np.arange(len(at)), size)
    gap = np.diff(doc, prepend=0)
    gap[at] = 0
    columns = (gap, tf - 1)
    width = [_widths(np.maximum.reduceat(c, at)) for c in columns]
    length = 1 + size * (width[0] + width[1])
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    out[start] = width[0] | (width[1] << 4)
    inner = np.arange(n) - at[block]
    base = (start + 1)[block]
    for c, w, before in zip(columns, width, (np.zeros_like(size), size * width[0]), strict=True):
        to = base + before[block] + inner * w[block]
        for b in range(int(w.max())):
            some = w[block] > b
            out[to[some] + b] = (c[some] >> (8 * b)) & 0xFF
    return out, {"list": lists[at], "start": start, "size": size, "first": doc[at], "last": doc[at + size - 1], "top": np.maximum.reduceat(impact, at)}


def unpack(block: np.ndarray, n: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and counts of a block's n postings."""
    wide = int(block[0] & 15), int(block[0] >> 4)
    out, at = [], 1
    for w in wide:
        number = np.zeros(n, np.int64)
        for b in range(w):
            number |= block[at + b : at + n * w : w].astype(np.int64) << (8 * b)
        out.append(number)
        at += n * w
    return first + np.cumsum(out[0]), out[1] + 1


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents with an id, as a table in the shared folder."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            for piece in textkit.chunks(batch):
                n = np.diff(words.terms(piece.column("text"), words.LETTERS_AND_DIGITS).first)
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        yield pa.record_batch([[n_docs], [n_terms]], names=["n_docs", "n_terms"])

    found = rows.select("text").mapInArrow(sizes, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = found[0] or 0, found[1] or 0

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for piece in textkit.chunks(batch):
                held.append(piece)
                size += pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
                if size >= SHARD_BYTES:
                    yield from _shard(pa.Table.from_batches(held), number, n_docs, n_terms)
                    number, held, size = number + 1, [], 0
        if held:
            yield from _shard(pa.Table.from_batches(held), number, n_docs, n_terms)

    return Index(written(rows.mapInArrow(shards, INDEX), "postings"), n_docs, n_terms)


def _shard(docs: pa.Table, number: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    found = words.terms(docs.column("text").combine_chunks(), words.LETTERS_AND_DIGITS)
    m = 75 + (25 * np.diff(found.first) * n_docs) // max(1, n_terms)
    names, code, doc, tf = found.counted()
    ids = docs.column("doc_id").to_numpy().astype(np.int64)
    none = pa.array([[]], pa.list_(pa.int32()))
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("blocks", pa.binary()), *((c, pa.list_(pa.int32())) for c in ("starts", "firsts", "lasts", "tops"))])
    yield pa.record_batch([pa.array([number]), pa.array([""]), pa.array([len(ids)]), pa.array([np.concatenate([ids, m]).tobytes()]), none, none, none, none], schema=schema)
    if not len(code):
        return
    out, b = pack(code, doc, tf, impacts(tf, m[doc]))
    head = np.flatnonzero(np.r_[True, np.diff(b["list"]) > 0])  # first block of each list
    n_blocks = np.diff(np.r_[head, len(b["list"])])
    at = np.r_[b["start"][head], len(out)]
    postings = np.add.reduceat(b["size"], head)
    inner = b["start"] - np.repeat(at[:-1], n_blocks)
    ends = np.r_[head, len(b["list"])]
    for a in range(0, len(head), ROWS):
        z = min(a + ROWS, len(head))
        part = slice(int(ends[a]), int(ends[z]))
        offsets = pa.array((ends[a : z + 1] - ends[a]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[part].astype(np.int32))) for x in (inner, b["first"], b["last"], b["top"])]
        blob = out[int(at[a]) : int(at[z])]
        binary = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((at[a : z + 1] - at[a]).astype(np.int32)), pa.py_buffer(blob)])
        yield pa.record_batch([pa.array(np.full(z - a, number)), names.take(pa.array(b["list"][head[a:z]])).cast(pa.string()), pa.array(postings[a:z]), binary, *lists], schema=schema)


class _List:
    """One term's postings in a shard."""

    def __init__(self, blocks: np.ndarray, n: int, starts: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, tops: np.ndarray, m: np.ndarray):
        self.blocks, self.n, self.starts, self.firsts, self.lasts, self.m = blocks, n, starts, firsts, lasts, m
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if len(starts) == 1:  # a cursor on each posting
            firsts, tops = self.block(0)
            lasts = firsts
        self.at = np.r_[firsts, lasts + 1].astype(np.int64)
        self.rise = np.r_[tops, -tops].astype(np.int64)
        self.top = int(tops.max())

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts."""
        if i not in self.unpacked:
            n = BLOCK if i + 1 < len(self.starts) else self.n - BLOCK * (len(self.starts) - 1)
            doc, tf = unpack(self.blocks[self.starts[i] :], n, int(self.firsts[i]))
            self.unpacked[i] = doc, impacts(tf, self.m[doc])
        return self.unpacked[i]

    def covering(self, doc: np.ndarray) -> np.ndarray:
        """Numbers of the blocks that the documents lie in."""
        i = np.searchsorted(self.lasts, doc)
        i = i[i < len(self.lasts)] if len(i) else i
        return np.unique(i[self.firsts[i] <= doc[: len(i)]])


def _best(query: list[tuple[_List, int]], n_docs: int, k: int, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that are among the k best so far, and their scores; earlier: the best scores before, descending."""
    threshold = int(earlier[k - 1]) if len(earlier) >= k else 1
    none = np.zeros(0, np.int64)
    if sum(w * x.top for x, w in query) < threshold:
        return none, none
    at = np.concatenate([x.at for x, _ in query])
    order = np.argsort(at, kind="stable")
    at = at[order]
    bound = np.cumsum(np.concatenate([x.rise * w for x, w in query])[order])
    last = np.flatnonzero(np.r_[at[1:] != at[:-1], True])
    begin, bound = at[last], bound[last]  # the last bound is 0: nothing lies beyond
    end = np.r_[begin[1:], n_docs]
    runs = np.argsort(-bound, kind="stable")
    total = np.zeros(n_docs, np.int64)
    done: list[set[int]] = [set() for _ in query]
    docs, scores, goal, i = none, none, 4 * k, 0
    while i < len(runs) and bound[runs[i]] >= threshold:
        j = i + max(1, int(np.searchsorted(np.cumsum((end - begin)[runs[i:]]), goal)))
        some = runs[i:j]
        some = np.sort(some[bound[some] >= threshold])
        for (x, w), seen in zip(query, done, strict=True):
            for b in x.covering(begin[some]).tolist():
                if b not in seen:
                    seen.add(b)
                    doc, impact = x.block(b)
                    total[doc] += w * impact
        size = (end - begin)[some]
        near = np.repeat(begin[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        near = near[total[near] >= threshold]
        docs, scores = np.r_[docs, near], np.r_[scores, total[near]]
        every = np.r_[earlier, scores]
        if len(every) >= k:
            threshold = max(threshold, int(np.partition(every, len(every) - k)[len(every) - k]))
        keep = scores >= threshold
        docs, scores = docs[keep], scores[keep]
        i, goal = j, 4 * goal
    return docs, scores


def _answer(k: int) -> Callable[[pa.Table], pa.Table]:
    so_far: dict = {}  # best scores of each query in the shards that this task has been through

    def answer(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        names, column = rows.column("term").to_pylist(), lambda c: rows.column(c).combine_chunks()
        own = names.index("")
        both = np.frombuffer(rows.column("blocks")[own].as_py(), np.int64)
        ids, m = both[: len(both) // 2], both[len(both) // 2 :]
        blobs, n = rows.column("blocks"), rows.column("n").to_numpy()
        parts = []
        for c in ("starts", "firsts", "lasts", "tops"):
            a = column(c)
            parts.append((a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)))
        entries = column("entries")
        to, items, weights = entries.offsets.to_numpy(), entries.values.field("item").to_pylist(), entries.values.field("weight").to_numpy(zero_copy_only=False)
        queries: dict = {}
        for i in range(len(names)):
            if i == own:
                continue
            x = _List(np.frombuffer(blobs[i].as_buffer(), np.uint8), int(n[i]), *(v[o[i] : o[i + 1]].astype(np.int64) for o, v in parts), m)
            for j in range(to[i], to[i + 1]):
                queries.setdefault(items[j], []).append((x, int(weights[j])))
        out_item, out_doc, out_score = [], [], []
        for item, query in queries.items():
            earlier = so_far.get(item, np.zeros(0, np.int64))
            doc, score = _best(query, len(ids), k, earlier)
            if not len(doc):
                continue
            best = np.lexsort((ids[doc], -score))[:k]
            so_far[item] = -np.sort(-np.r_[earlier, score[best]])[:k]
            out_item += [item] * len(best)
            out_doc.append(ids[doc[best]])
            out_score.append(score[best])
        number = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        return pa.table([pa.array(out_item, entries.values.field("item").type), number(out_doc), number(out_score)], names=["item", "doc_id", "score"])

    return answer


def search(index: Index, queries: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each query with a score above 0 (all, if fewer), equal
    scores by ascending doc_id. A query's terms count as often as it has them; rows that repeat an item_id are one query;
    rows without one are left out. What is sent to all executors is checked by size."""
    listed = queries.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.explode(words.column(F.col(text).cast("string"), words.LETTER_OR_DIGIT_RUN)).alias("term"))
    asked = written(listed.groupBy("item", "term").agg(F.count("*").alias("times")), "query-terms")
    n_parts = -(-asked.select("item").distinct().count() // ITEMS)
    wanted = written(asked.select("term").distinct(), "wanted-terms")
    df = index.table.select("term", "n").join(broadcast_if_small(wanted), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    part = F.pmod(F.xxhash64("item"), F.lit(max(1, n_parts))).alias("part")
    weighed = asked.join(df, "term").select(part, "term", "item", (F.col("times") * weight).alias("weight")).where("weight > 0")
    entries = written(weighed.groupBy("part", "term").agg(F.collect_list(F.struct("item", "weight")).alias("entries")), "query-weights")
    hits = index.table.where("term <> ''").join(broadcast_if_small(entries), "term")
    shards = index.table.where("term = ''").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_parts - 1)).cast("long"))))
    work = shards.unionByName(hits, allowMissingColumns=True)
    found = work.groupBy("shard", "part").applyInArrow(_answer(k), T.StructType([T.StructField("item", asked.schema["item"].dataType), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("item").alias(item_id), "rank", "doc_id", "score")
