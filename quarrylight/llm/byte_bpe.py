"""Byte-level BPE encoding and decoding.

Words are split off by the tokenizer's pattern (vectorised over code points). The merges are a fold of Spark's higher-order
functions over the byte pieces of distinct words: each step joins the leftmost pair of least rank, found in a literal table of
pairs of ids, until no pair has a rank. The table stands in the plan as a scalar subquery over one row, which Spark evaluates
once a query and hands to the tasks as a literal value: written out in the plan, its entries would be in every description of
the plan that the driver makes. Words that have a rank themselves need no fold. The COMMON commonest words of the corpus are folded once and their ids sent to all tasks (a
bounded table, which changes no result); every other word is folded once for each run of documents with CHUNK_BYTES of text,
where it stands, so that nothing is shuffled; the words' codes are written before that. Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import textkit
from quarrylight.llm.common import discard, fresh, written

#: Words whose ids are kept in a table that every task holds.
COMMON = 300_000
#: Text of the documents that share a list of distinct words; a longer document has a list of its own.
CHUNK_BYTES = 4 << 20
#: Text that is split at once, or one document; what a step holds is about 40 bytes for each.
SPLIT_BYTES = 1 << 19
#: Lists of documents in a row group of the written codes.
GROUP_ROWS = 2
#: Words that are put together at once.
STEP_WORDS = 100_000
#: Longer words (bytes) are merged with a heap: the fold's work grows with the square of a word's length.
LONG_WORD = 2_000
BUCKETS = 65_536
#: Lists that the common words are dealt to for the fold, by hash: about 600 words in each.
FOLD_LISTS = 512
_NONE = 2**31 - 1
_KEY_BITS = 24
_KEY = 1 << _KEY_BITS  # ids are below it
#: Unicode white space. Fixed values.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_kinds: np.ndarray | None = None


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _kind_table() -> np.ndarray:
    global _kinds
    if _kinds is None:
        first = {"L": _LETTER, "N": _NUMBER}
        _kinds = np.array([first.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
        _kinds[_WHITE] = _SPACE
    return _kinds


def word_starts(points: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in code points; each ends where the next begins. doc_start: offsets of the texts that
    are not empty, ascending. The pattern: contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers, of other signs,
    each with one space before it; white space but for its last sign if something follows; white space."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kind_table()[points]
    head = np.r_[True, kind[1:] != kind[:-1]]
    head[doc_start] = True
    s = np.flatnonzero(head)
    e = np.r_[s[1:], n]
    k = kind[s]
    opens_doc = np.zeros(n + 1, bool)
    opens_doc[doc_start] = True
    opens_doc[n] = True
    ends_doc = opens_doc[e]
    white = k == _SPACE
    lends = white & ~ends_doc & (points[e - 1] == 0x20)  # its last space goes to the next run
    begin = np.zeros(n, bool)
    begin[s[white & (ends_doc | ~lends | (e - s > 1))]] = True
    begin[e[white & ~ends_doc & ~lends] - 1] = True
    led = np.r_[False, lends[:-1]]
    start = s - led
    # an apostrophe alone, with letters right after it in the same text
    quote = (k == _OTHER) & (e - s == 1) & (points[s] == 0x27) & ~led & ~ends_doc
    at = np.flatnonzero(quote)
    at = at[k[at + 1] == _LETTER]
    one = points[e[at]]
    two = np.where(e[at + 1] - s[at + 1] > 1, points[np.minimum(e[at] + 1, n - 1)], 0)
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for pair in ("re", "ve", "ll"):
        size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
    start[at + 1] += size
    begin[start[~white & (start < e)]] = True
    return np.flatnonzero(begin)


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All words of the texts in order, and for each text (and one more) how many stand before it."""
    joined = "".join(texts)
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = word_starts(points, off[:-1][np.diff(off) > 0])
    cut = starts.tolist()
    if not cut:
        return [], np.zeros(len(texts) + 1, np.int64)
    return [joined[a:b] for a, b in zip(cut, [*cut[1:], len(joined)], strict=True)], np.searchsorted(starts, off)


def _texts(piece: pa.RecordBatch) -> list[str]:
    return [t or "" for t in piece.column("text").to_pylist()]


def pair_table(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The literal: `pairs`, maps from the key of two ids to the id of what they join to, in BUCKETS; `first`, the entry of each two
    bytes at 256 x + y; `last`, that of a byte with nothing after it. An entry of the fold is _KEY times the rank of the pair that
    begins with a piece, plus the piece's id."""
    found = [(a, b, rank) for piece, rank in ranks.items() for i in range(1, len(piece)) if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None]
    a, b, rank = np.array(found, np.int64).reshape(-1, 3).T
    bucket = _bucket(a, b)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1)).astype(np.int32)
    maps = pa.MapArray.from_arrays(pa.array(ends), pa.array((a * _KEY + b)[order]), pa.array(rank[order].astype(np.int32)))
    byte = [ranks[bytes([i])] for i in range(256)]
    first = [ranks.get(bytes([x, y]), _NONE) * _KEY + byte[x] for x in range(256) for y in range(256)]
    rows = {"pairs": pa.ListArray.from_arrays(pa.array([0, BUCKETS], pa.int32()), maps), "first": pa.array([first], pa.list_(pa.int64())), "last": pa.array([[_NONE * _KEY + x for x in byte]], pa.list_(pa.int64()))}
    return spark.createDataFrame(pa.table(rows)).select(F.struct("pairs", "first", "last").alias("ranks")).scalar()


def _bucket(a, b):
    return (a * 31 + b) % BUCKETS


def bytes_of(word: Column) -> Column:
    """The bytes of a string's UTF-8 form, as an array of int."""
    return F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), F.ascii)


def with_ids(df: DataFrame, words: str, name: str, literal: Column) -> DataFrame:
    """df with the column `name`: bpe_ids of the words. Spark wants a subquery in a column of its own, so a row holds the table
    (some MB) until it is folded: rows should be few, with many words each."""
    held = fresh("ranks", df)
    return df.withColumn(held, literal).withColumn(name, bpe_ids(F.col(words), F.col(held))).drop(held)


def bpe_ids(words: Column, literal: Column) -> Column:
    """The fold: ids of each word of an array, its bytes an array of int, as an array of arrays of int; null for words over
    LONG_WORD bytes. Its state holds an entry for each piece and the least entry, in which the least rank is."""
    end = F.lit(_NONE * _KEY)

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def piece(entry: Column) -> Column:
        return entry.bitwiseAND(F.lit(_KEY - 1))

    def fold(table: Column, word: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            return F.element_at(F.get(table["pairs"], _bucket(a, b).cast("int")), a * F.lit(_KEY) + b).cast("long")

        def state(entries: Column) -> Column:
            return let(entries, lambda e: F.struct(e.alias("e"), F.array_min(e).alias("low")))

        def merge(e: Column, low: Column, i: Column) -> Column:
            """The pair at i - 1 becomes one piece; the entries of it and of the piece before it have other ranks then."""
            new = F.shiftrightunsigned(low, _KEY_BITS)

            def put(x: Column, j: Column) -> Column:
                return (
                    F.when((j < i - 2) | (j > i), x)
                    .when(j == i - 2, let(piece(x), lambda a: F.coalesce(rank(a, new) * F.lit(_KEY), end) + a))
                    .when(j == i - 1, F.coalesce(let(piece(F.get(e, i + 1)), lambda b: rank(new, b) * F.lit(_KEY)), end) + new)
                )

            return F.filter(F.transform(e, put), lambda x: x.isNotNull())

        def step(s: Column, _: Column) -> Column:
            at = F.array_position(s["e"], s["low"]).cast("int")
            return F.when(s["low"] >= end, s).otherwise(state(let(at, lambda i: merge(s["e"], s["low"], i))))

        begin = F.transform(word, lambda x, j: F.coalesce(F.get(table["first"], x * 256 + F.get(word, j + 1)), F.get(table["last"], x)))
        return F.transform(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1))), state(begin), step)["e"], lambda x: piece(x).cast("int"))

    return let(literal, lambda table: F.transform(words, lambda w: F.when(F.size(w) <= LONG_WORD, fold(table, w))))


def merge_with_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one very long word, in n log n steps."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that begins here
    before = list(range(-1, n - 1))
    live = [True] * n
    heap = []

    def look(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        look(i)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not (live[i] and end[i] == j and j < n and live[j] and end[j] == e):
            continue
        live[j] = False
        end[i] = e
        if e < n:
            before[e] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def common_words(texts: DataFrame, limit: int = COMMON) -> DataFrame:
    """(word, n): words by count over all texts. A task leaves out what it saw once only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for piece in textkit.chunks(batch, size=SPLIT_BYTES):
                seen.update(split_words(_texts(piece))[0])
                if len(seen) > 1_000_000:
                    seen = Counter({w: c for w, c in seen.items() if c > 1})
        often = [(w, c) for w, c in seen.items() if c > 1 and len(w.encode()) <= LONG_WORD]
        for i in range(0, len(often), 100_000):
            part = often[i : i + 100_000]
            yield pa.record_batch([pa.array([w for w, _ in part], pa.string()), pa.array([c for _, c in part], pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(limit)


def encode_decode(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False, common: int = COMMON) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids as array<int>) of every whole text.

    Null text is an empty one: no ids, the digest of no bytes. Rows that repeat a doc_id or text, and null doc_ids, are kept as
    they are. No rows: no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ranks = load_ranks(ranks_path)
    literal = pair_table(spark, ranks)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = written(common_words(plain.select("text"), common), "words")
    lists = found.select("word", F.pmod(F.xxhash64("word"), F.lit(FOLD_LISTS)).alias("list")).repartition(spark.sparkContext.defaultParallelism, "list")
    lists = lists.groupBy("list").agg(F.collect_list("word").alias("words")).withColumn("bytes", F.transform("words", bytes_of))
    table = with_ids(lists, "bytes", "ids", literal).select("words", "ids").toArrow()
    discard(found)
    names, ids = (table.column(c).combine_chunks().flatten() for c in ("words", "ids"))
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    places, table_ids = _known_words(names, ids, ranks)
    known = spark.sparkContext.broadcast(places)
    del places
    sent = spark.sparkContext.broadcast((table_ids, (np.frombuffer(b"".join(pieces), np.uint8), np.r_[0, np.cumsum([len(p) for p in pieces])])))
    long_ranks = spark.sparkContext.broadcast(ranks)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = known.value.get
        doc_ids, n_words, codes, own, held = [], [], [], {}, 0

        def chunk() -> pa.RecordBatch:
            return pa.record_batch([pa.array([doc_ids], pa.list_(pa.int64())), pa.array([n_words], pa.list_(pa.int32())), pa.array([b"".join(codes)], pa.binary()), _byte_lists(list(own))], names=["doc_ids", "n_words", "codes", "rare"])

        for batch in batches:
            for piece in textkit.chunks(batch, size=SPLIT_BYTES):
                words, first = split_words(_texts(piece))
                code = np.fromiter(map(find, words, repeat(-1)), np.int32, len(words))
                for i in np.flatnonzero(code < 0).tolist():
                    code[i] = -1 - own.setdefault(words[i], len(own))
                doc_ids += piece.column("doc_id").to_pylist()
                n_words += np.diff(first).tolist()
                codes.append(code.astype("<i4").tobytes())
                held += sum(map(len, words))
                if held >= CHUNK_BYTES:
                    yield chunk()
                    doc_ids, n_words, codes, own, held = [], [], [], {}, 0
        if doc_ids:
            yield chunk()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common_ids, common_off), (letters, letter_off) = sent.value
        letter_len = np.diff(letter_off)
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, n_words, rare, rare_ids = (batch.column(c)[k].values for c in ("doc_ids", "n_words", "rare", "rare_ids"))
                rare_ids, rare_off = _long_words(rare_ids, rare, long_ranks)
                code = np.frombuffer(batch.column("codes")[k].as_buffer(), "<i4").astype(np.int64)
                begin = np.r_[common_off[:-1], rare_off[:-1] + len(common_ids)]
                size = np.r_[np.diff(common_off), np.diff(rare_off)]
                every = np.r_[common_ids, rare_ids]
                word_ends = np.cumsum(n_words.to_numpy().astype(np.int64))
                part = np.r_[-1, (word_ends - 1) // STEP_WORDS]
                cut = np.flatnonzero(np.diff(part)[1:]) + 1
                for i, j in zip(np.r_[0, cut].tolist(), np.r_[cut, len(doc_ids)].tolist(), strict=True):
                    if i == j:
                        continue
                    low = int(word_ends[i - 1]) if i else 0
                    row = code[low : word_ends[j - 1]]
                    row = np.where(row >= 0, row, len(common_off) - 2 - row)
                    ids = every[_ranges(begin[row], size[row])]
                    ends = np.r_[0, np.cumsum(size[row])][np.r_[0, word_ends[i:j] - low]]
                    text_ends = np.r_[0, np.cumsum(letter_len[ids])][ends]
                    data, decoded = memoryview(ids.astype("<u4").tobytes()), memoryview(letters[_ranges(letter_off[:-1][ids], letter_len[ids])].tobytes())
                    columns = [
                        doc_ids.slice(i, j - i),
                        pa.array(np.diff(ends)),
                        pa.array([hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]),
                        pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(text_ends[:-1].tolist(), text_ends[1:].tolist(), strict=True)]),
                    ]
                    if keep_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids])

    # written, so that no task runs two Python workers, one with the common words and one with their ids; a few lists to a row
    # group, as Spark reads a group's rows at once
    coded = written(plain.mapInArrow(look_up, "doc_ids array<long>, n_words array<int>, codes binary, rare array<array<int>>"), "codes", **{"parquet.block.row.count.limit": GROUP_ROWS})
    return with_ids(coded, "rare", "rare_ids", literal).mapInArrow(assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def _known_words(names: pa.Array, ids: pa.Array, ranks: dict[bytes, int]) -> tuple[dict[str, int], tuple[np.ndarray, np.ndarray]]:
    """Where each word stands in a table of ids: the common words, and all words with a rank of their own, which are not merged."""
    every, off = _flat(ids)
    places = {w: i for i, w in enumerate(names.to_pylist())}
    whole = []
    for piece, rank in ranks.items():
        try:
            places[piece.decode()] = len(off) - 1 + len(whole)
        except UnicodeDecodeError:  # part of a sign
            continue
        whole.append(rank)
    return places, (np.r_[every, np.array(whole, np.int64)], np.r_[off, off[-1] + 1 + np.arange(len(whole))])


def _byte_lists(words: list[str]) -> pa.Array:
    """One list of the words' bytes."""
    data = [w.encode() for w in words]
    ends = np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int32)
    each = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), np.uint8).astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), each)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(size)].astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)


def _long_words(lists: pa.Array, words: pa.Array, ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words; those that the fold left out (null) are merged here."""
    if not lists.null_count:
        return _flat(lists)
    every = lists.to_pylist()
    for i in np.flatnonzero(lists.is_null().to_numpy(zero_copy_only=False)).tolist():
        every[i] = merge_with_heap(bytes(words[i].as_py()), ranks.value)
    return _flat(pa.array(every, pa.list_(pa.int32())))
