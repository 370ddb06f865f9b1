"""Token ids in binary shards of fixed-width bit packing.

A shard holds the ids of consecutive documents. Each id takes the least bits that the vocabulary needs; ids are packed in
blocks of BLOCK ids, each block begins on a byte, and a table of block offsets lets a reader unpack any run of ids with
numpy without reading the rest.

Layout, little-endian: magic (8 bytes); blocks; doc ids (i64); ends of the documents in ids (u64); block offsets in bytes from
the file's start (u64, blocks + 1); bits, block length (u32 each); documents, ids, blocks (u64 each); magic. So a writer holds
one block and the list of documents, whatever the size of the shard.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm import textkit
from quarrylight.llm.common import new_dir, written

MAGIC = b"QLPACK02"
TAIL = struct.Struct("<IIQQQ8s")
BLOCK = 8192
#: Ids in a shard before the next one begins (a longer document has a shard of its own).
SHARD_IDS = 100_000_000
#: Stored instead of a null doc_id.
NO_ID = -(2**63)
#: Words in each of the two generations of an encoder's cache.
CACHE_WORDS = 300_000
#: Ids that a reader holds at once, on average.
READ_IDS = 1_000_000
#: Words that the tokenizer gets at once.
BATCH_WORDS = 4_000
_encoders: dict[str, WordEncoder] = {}


def width(vocabulary: int) -> int:
    """Bits that an id below `vocabulary` needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    return np.packbits(((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    one = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return one.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class ShardWriter:
    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.keys: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.offsets = [len(MAGIC)]
        self.left = np.zeros(0, np.uint32)
        self.n_ids = self.n_docs = 0
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(doc_ids)
        self.lengths.append(lengths)
        self.n_ids += len(ids)
        self.n_docs += len(doc_ids)
        ids = np.r_[self.left, ids]
        whole = len(ids) - len(ids) % self.block
        for i in range(0, whole, self.block):
            self._write(ids[i : i + self.block])
        self.left = ids[whole:]

    def _write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if len(self.left):
            self._write(self.left)
        ends = np.cumsum(np.concatenate(self.lengths))
        for x, kind in ((np.concatenate(self.keys), "<i8"), (ends, "<u8"), (np.array(self.offsets), "<u8")):
            self.out.write(x.astype(kind).tobytes())
        self.out.write(TAIL.pack(self.bits, self.block, len(ends), self.n_ids, len(self.offsets) - 1, MAGIC))


class Shard:
    """A reader with random access by document or by id position."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        tail = self.file.size() - TAIL.size
        self.bits, self.block, n_docs, self.n_ids, n_blocks, magic = TAIL.unpack(self.file.read_at(TAIL.size, tail))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {path}")
        at = tail - 16 * n_docs - 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(self.file.read_at(8 * n_docs, at), "<i8")
        self.ends = np.frombuffer(self.file.read_at(8 * n_docs, at + 8 * n_docs), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self.file.read_at(8 * (n_blocks + 1), at + 16 * n_docs), "<u8").astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from position a up to b: only the blocks that hold them are read."""
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, (b - 1) // self.block + 1
        data = self.file.read_at(int(self.offsets[j] - self.offsets[i]), int(self.offsets[i]))
        out = []
        for k in range(i, j):
            part = data[self.offsets[k] - self.offsets[i] : self.offsets[k + 1] - self.offsets[i]]
            out.append(unpack(part, self.bits, min(self.block, self.n_ids - k * self.block)))
        return np.concatenate(out)[a - i * self.block : b - i * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class WordEncoder:
    """The tokenizers library behind a bounded cache. The tokenizer lowers case and its pattern never joins what ASCII white
    space parts, so each run between white space is encoded once, and a document's ids are those of its runs in order. Signs
    at the end of a run, after an ASCII letter or digit, are matches of their own and are cached apart. A text that holds one of
    the tokenizer's added tokens, which the library finds before all else, goes to the library as a whole.

    The cache has two generations: when the newer is full, the older is dropped, and a word found in the older moves to the
    newer, so that common words are never learnt again."""

    SIGNS = b".,;:!?#$%&*|"
    PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks take the cores; threads would hold memory of their own
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # what only looks like an added token after lowering is spelled out
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text the bytes of its ids as little-endian unsigned 32-bit integers."""
        special = {i: np.array(self.whole.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for i, t in enumerate(texts) if any(a in t for a in self.added)}
        split = [() if i in special else t.lower().split() for i, t in enumerate(texts)]
        here = set().union(*split)
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        new = here.difference(self.known)
        older = self.older
        again = {w: older[w] for w in new if w in older}
        self.known.update(again)
        self._learn(new.difference(again))
        get = self.known.__getitem__
        return [special[i] if i in special else b"".join(map(get, w)) for i, w in enumerate(split)]

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        ended: list[tuple[bytes, bytes, bytes]] = []
        single: set[bytes] = set()
        for word in new:
            core = word.rstrip(self.SIGNS)
            if core and len(core) < len(word) and core[-1] in self.PLAIN:
                ended.append((word, core, word[len(core) :]))
                single.update(ended[-1][1:])
            else:
                single.add(word)
        single.difference_update(known)
        letters, other = [], []
        for word in single:
            (letters if (text := word.decode()).isalpha() else other).append(text)
        for i in range(0, len(letters), BATCH_WORDS):
            part = letters[i : i + BATCH_WORDS]
            groups = [part[j : j + 500] for j in range(0, len(part), 500)]
            for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, "<u4")
                ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
                if len(ends) != len(group):  # a letter whose lower case is several signs
                    other += group
                    continue
                data = ids.tobytes()
                known.update(zip((w.encode() for w in group), (data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
        for i in range(0, len(other), BATCH_WORDS):
            part = other[i : i + BATCH_WORDS]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[word.encode()] = np.array(found.ids, "<u4").tobytes()
        for word, core, signs in ended:
            known[word] = known[core] + known[signs]


def encoder_of(path: str) -> WordEncoder:
    """One encoder for each Python worker, however many tasks it runs."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes every whole text, appends end_id, writes shards in ascending doc_id order; returns the table of shards:
    path, place (order among the shards), n_docs, n_ids, start (ids in all shards before).

    Null text is an empty one; null doc_id sorts first and is kept as NO_ID; rows that repeat a doc_id stand side by side;
    no documents: no shards. Other columns are ignored. A task writes files under new names and lists them in a row that
    Spark commits, so files of lost or repeated attempts are never read.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "shards")
    bits = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        last = np.array([end_id], "<u4").tobytes()
        seq, out, shard = 0, None, None

        def flush() -> pa.RecordBatch:
            shard.close()
            out.close()
            fs.move(f"{base}/{name}.part", f"{base}/{name}")
            return pa.record_batch([[f"{folder}/{name}"], [int(shard.keys[0][0])], [seq], [shard.n_docs], [shard.n_ids]], names=["path", "first_doc", "seq", "n_docs", "n_ids"])

        for batch in batches:
            for piece in textkit.chunks(batch):
                if shard is None:
                    name = f"{uuid.uuid4().hex}.qlp"
                    out = fs.open_output_stream(f"{base}/{name}.part")
                    shard = ShardWriter(out, bits)
                buf, off = textkit.raw(piece.column("text"))
                data = buf.tobytes()
                found = [x + last for x in encoder.encode([data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])]
                shard.add(piece.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False), np.array([len(x) // 4 for x in found]), np.frombuffer(b"".join(found), "<u4"))
                if shard.n_ids >= shard_ids:
                    yield flush()
                    seq, shard = seq + 1, None
        if shard is not None:
            yield flush()

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
    shards = written(ordered.mapInArrow(run, "path string, first_doc long, seq long, n_docs long, n_ids long"), "shards")
    order = Window.orderBy("first_doc", "seq", "path")  # a row for each shard, not for each document
    return shards.withColumn("place", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_digests(shards: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32, first_id and last_id of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(path)
                begin = np.r_[0, shard.ends[:-1]]
                part = begin // READ_IDS
                cut = np.flatnonzero(np.diff(part)) + 1
                for i, j in zip(np.r_[0, cut].tolist(), np.r_[cut, len(begin)].tolist(), strict=True):
                    low = int(begin[i])
                    ids = shard.ids(low, int(shard.ends[j - 1])).astype("<u4")
                    data = memoryview(ids.tobytes())
                    a, b = begin[i:j] - low, shard.ends[i:j] - low
                    crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    doc_ids = shard.doc_ids[i:j]
                    columns = [pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(begin[i:j] + start), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(ids[a].astype(np.int64)), pa.array(ids[b - 1].astype(np.int64))]
                    yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "first_id", "last_id"])

    n = max(1, shards.count())
    return shards.select("path", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, last_id long")
