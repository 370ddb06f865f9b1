"""Families of near copies from bottom-k sketches of word shingles.

A text's sketch holds the k least hashes of its shingles. Of two texts the k least hashes of both sketches together are the
sketch of their union, and the share of these that both have estimates (for texts of k shingles or fewer: is) the Jaccard
similarity of their shingles. Texts whose similarity reaches the threshold are linked; families are what links connect.

Texts of equal sketches are one from the start. Two sketches above the threshold t share at least t of the larger one's hashes,
so they share one of the rarest (1 - t) of either: only these are keys, and what very many texts have is a key for hardly any.
Within a key every text is first held against the key's least text; after that, pairs are made only of texts that are not yet
connected. So a group of very many near copies costs its size. No pair above the threshold with different families is
missed, and none is capped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.identity import families
from quarrylight.session import discard, written

SHINGLE_WORDS = 5
SKETCH = 256
LEAST = 0.8


def crc(shingle: Column) -> Column:
    return F.crc32(shingle)


def md5_number(shingle: Column) -> Column:
    """The first 32 bits of the md5, which other engines have too."""
    return _number(_digits(shingle))


def _digits(shingle: Column) -> Column:
    return F.substring(F.md5(shingle), 1, 8)


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def sketch(text: Column, size: int = SKETCH, words: int = SHINGLE_WORDS, hashed: Callable[[Column], Column] = crc) -> Column:
    """The `size` least different hashes of the shingles of the folded text, ascending. Fewer words than a shingle: empty."""

    def least(w: Column) -> Column:
        def shingle(word: Column, i: Column) -> Column:
            return F.concat(word, *[c for j in range(1, words) for c in (F.lit(" "), F.get(w, i + j))])

        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(0)))
        # digits of one length are in the order of their numbers: only those that stay are made numbers
        each, kept = (_digits, _number) if hashed is md5_number else (hashed, None)
        found = F.slice(F.sort_array(F.array_distinct(F.transform(starts, lambda x, i: each(shingle(x, i))))), 1, size)
        return found if kept is None else F.transform(found, kept)

    return T.let(T.words(T.fold(text)), least)


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Share of the union's sketch that both have; 0 if either is empty."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(union)).otherwise(0.0)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, size: int = SKETCH, words: int = SHINGLE_WORDS, hashed: Callable[[Column], Column] = crc) -> DataFrame:
    """(doc_id, family, n_shingles): for every row its family's least id, and how many hashes its sketch holds. Texts without a
    shingle, nulls too, are families of their own, but for rows that repeat an id, which are one; null ids are left out."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), sketch(F.col(text).cast("string"), size, words, hashed).alias("s"))
    rows = written(rows.withColumn("same", F.when(F.size("s") > 0, F.sha2(F.col("s").cast("string"), 256))), "sketches")
    whole = written(rows.where("same is not null").groupBy("same").agg(F.min("id").alias("rep"), F.first("s").alias("s")), "sketch-classes")
    reps = whole.select("same", "s", F.size("s").alias("n"), F.monotonically_increasing_id().alias("k"))
    reps = written(reps, "sketch-rows")  # `k` names a sketch; written, so that it stays the same

    each = reps.select("k", "n", F.explode("s").alias("h"))
    rarity = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    of_one = Window.partitionBy("k")  # the hashes of one sketch; those that no other has come first and are not dealt
    place = F.col("n") - F.count("*").over(of_one) + F.row_number().over(of_one.orderBy("df", "h"))
    keys = each.join(rarity, "h").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    keys = written(keys.select("h", "k", "n"), "sketch-keys")
    near = lambda a, b: F.least(a, b) >= least * F.greatest(a, b) - 1e-9
    sketches = reps.select("k", "s")

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(sketches.toDF("u", "su"), "u").join(sketches.toDF("v", "sv"), "v")
        return written(both.where(likeness(F.col("su"), F.col("sv"), size) >= least - 1e-9).select("u", "v"), "links")

    hubs = keys.groupBy("h").agg(F.min(F.struct("k", "n")).alias("hub"))
    first = linked(keys.join(hubs, "h").where(F.col("k") > F.col("hub.k")).where(near(F.col("n"), F.col("hub.n"))).select(F.col("hub.k").alias("u"), F.col("k").alias("v")))
    root = families(first)
    rooted = keys.join(root.toDF("k", "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    open_ = rooted.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("h")
    left = written(rooted.join(open_, "h", "left_semi"), "open-keys")
    other = left.toDF("h", "v", "m", "other")
    more = left.join(other, "h").where((F.col("root") < F.col("other")) & near(F.col("n"), F.col("m"))).select(F.least("k", "v").alias("u"), F.greatest("k", "v").alias("v"))
    second = linked(more)
    found = families(first.union(second)).toDF("k", "root")
    named = reps.select("same", "k").join(found, "k", "left").withColumn("root", F.coalesce("root", "k")).join(whole.select("same", "rep"), "same")
    least_id = named.groupBy("root").agg(F.min("rep").alias("family"))
    classes = named.join(least_id, "root").select("same", "family")
    out = rows.join(classes, "same", "left").select(F.col("id").alias(doc_id), F.coalesce("family", "id").alias("family"), F.size("s").alias("n_shingles"))
    discard(left, keys)
    return out
