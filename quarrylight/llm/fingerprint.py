"""MinHash fingerprints of documents.

HASHES universal hash permutations over the five-word shingles of a text, in vectorised numpy; the fingerprint keeps the low
BITS of each least value, as hex. The likeness of two fingerprints estimates the Jaccard similarity of the shingle sets,
corrected for values that agree by chance. Near duplicates over a whole table: bands of the signature are joined in Spark and
the Jaccard similarity of the candidates is verified on their shingle sets (`duplicate_classes`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import similar, textkit

SHINGLE = 5
HASHES = 128
BITS = 8
#: Bands of ROWS values each for the candidates of near duplicates.
ROWS = 5
SIMILARITY = 0.8
#: Documents of a range that one task puts in order, on average.
RANGE_ROWS = 4_000


def signatures(w: textkit.Words, k: int = SHINGLE, hashes: int = HASHES) -> np.ndarray:
    """Least value of each permutation for each document: uint32, all ones for a document without words."""
    h, first = textkit.shingles(w, k)
    n = np.diff(first)
    out = np.full((len(n), hashes), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(n)
    if len(full):
        begin = first[:-1][full]
        factor, shift = textkit.constants(hashes, 11), textkit.constants(hashes, 12)
        value = np.empty_like(h)
        for j in range(hashes):
            np.multiply(h, factor[j], out=value)
            value += shift[j]
            out[full, j] = np.minimum.reduceat(value, begin) >> np.uint64(32)
    return out


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints, row by row: 0 to 1."""
    chance = 2.0**-bits
    mask = np.uint32((1 << bits) - 1)
    return np.clip(((a & mask == b & mask).mean(1) - chance) / (1 - chance), 0.0, 1.0)


def _hex(s: np.ndarray) -> list[str]:
    data = s.astype(np.uint8).tobytes()
    n = s.shape[1]
    return [data[i : i + n].hex() for i in range(0, len(data), n)]


def _edited(text: str, after: str) -> str:
    """The last quarter (rounded down) of the code points gives way to as many from the start of `after`, or all it has."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def in_ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents dealt in ranges of ascending doc_id; each range also gets the first document of the next one, marked `extra`.

    The bounds are quantiles of the ids (a few thousand numbers at most, whatever the size of the table); a range whose ids
    are all taken by an earlier one doesn't exist. Texts are moved once.
    """
    spark = docs.sparkSession
    n = docs.count()
    parts = int(min(4096, max(1, n // RANGE_ROWS)))
    bounds = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    split = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    dealt = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(split, lambda b: b <= F.col("doc_id")))))
    least = sorted((r["range"], r["low"], r["nulls"]) for r in dealt.groupBy("range").agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect())
    first = [(low, before) for (before, _, _), (_, low, _) in zip(least, least[1:], strict=False)]  # at most one for each range
    heads = spark.createDataFrame(first or [(None, None)], "low bigint, before int")
    joined = dealt.join(F.broadcast(heads), F.col("doc_id") == F.col("low"), "left")
    homes = F.when(F.col("before").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")))).otherwise(
        F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("range"), F.lit(True).alias("extra")))
    )
    flat = joined.select("doc_id", "text", F.explode(homes).alias("home")).select("home.range", "home.extra", "doc_id", "text")
    return flat.repartition(max(1, len(least)), "range").sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), F.md5("text")), len(least)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    The edited text of a document ends with the start of the next one in ascending doc_id (after the last: the first). Null
    text is empty; texts without words have the fingerprint of all ones and are alike. A null doc_id comes before all others;
    rows that repeat a doc_id follow one another in the order of their texts' md5. One document alone is its own next. No rows:
    no rows. Other columns are ignored, whatever their names.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    opening = plain.orderBy(F.col("doc_id").asc_nulls_first(), F.md5("text")).limit(1).collect()
    if not opening:
        opening = [{"text": ""}]
    head_text = opening[0]["text"]
    dealt, _ = in_ranges(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int, int | None, str, np.ndarray] | None = None  # range, id, text, signature

        def finished(rows: list[tuple], following: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
            """rows: (id, text, signature); following: of each row's next document."""
            edited = [_edited(t, f[0]) for (_, t, _), f in zip(rows, following, strict=True)]
            own = np.stack([r[2] for r in rows])
            changed = np.concatenate([signatures(textkit.words(piece.column("text"))) for piece in textkit.chunks(pa.record_batch([pa.array(edited, pa.string())], names=["text"]))])
            return pa.record_batch(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array(_hex(own)),
                    pa.array(_hex(changed)),
                    pa.array(likeness(own, changed)),
                    pa.array(likeness(own, np.stack([f[1] for f in following]))),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        def last(w) -> pa.RecordBatch:
            return finished([w[1:]], [(head_text, signatures(textkit.words(pa.array([head_text])))[0])])

        for batch in batches:
            for piece in textkit.chunks(batch):
                sig = signatures(textkit.words(piece.column("text")))
                rows, following = [], []
                for r, extra, i, t, s in zip(piece.column("range").to_pylist(), piece.column("extra").to_pylist(), piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), sig, strict=True):
                    if waiting is not None:
                        if waiting[0] == r:
                            rows.append(waiting[1:])
                            following.append((t, s))
                        else:
                            yield last(waiting)
                    waiting = None if extra else (r, i, t, s)
                if rows:
                    yield finished(rows, following)
        if waiting is not None:
            yield last(waiting)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """a, b: shingle hashes, each once, ascending."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _band_keys(w: textkit.Words) -> np.ndarray:
    sig = signatures(w)
    bands = HASHES // ROWS
    keys = np.zeros((len(sig), bands), np.uint64)
    for j, c in enumerate(textkit.constants(ROWS, 13)):
        keys += sig[:, j : bands * ROWS : ROWS].astype(np.uint64) * c
    keys = textkit.mix(keys) | np.uint64(1)
    keys[np.diff(w.first) == 0] = 0
    return keys


def _sets(w: textkit.Words) -> list[np.ndarray]:
    h, first = textkit.shingles(w, SHINGLE)
    return [np.unique((h[a:b] >> np.uint64(32)).astype(np.uint32)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id): near duplicates by bands of the signature, with Jaccard similarity of five-word shingle sets verified.

    Classes are connected components of verified pairs and exact copies, named by their least doc_id. Nulls, repeated ids and
    empty texts: see `similar.classes`.
    """
    def near(both: np.ndarray, others: np.ndarray, one: int) -> np.ndarray:
        return both >= similarity * (others + one - both) - 1e-9

    method = similar.Method(keys=_band_keys, forms=_sets, alike=lambda a, b: _jaccard(a, b) >= similarity, near=near, least_length=0.0)
    return similar.classes(docs, method, doc_id, text)
