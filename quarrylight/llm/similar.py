"""Classes of near duplicates from band keys: candidates, verification, components. Shared by the operators on documents.

Exact copies are put aside by the hash of their texts, so a text is compared once however often it stands in the table. Two
documents are candidates if they share a band key. Pairs within a key are not spelled out: a document is compared with one hub,
the one most of its keys have, and what is alike gets a common root. The first round looks at a few keys of each document, which
is enough for most of a large group; later ones at all keys that still have several roots.
What then still has different roots is compared and verified within each key, in blocks of bounded size, so that only links
between roots leave a block. A pair is compared in the first key that it shares, and aligned if it has enough parts in common.
Nothing is left out: hubs only save comparisons within a component. Roots are ordered by a hash of the id (a bijection), so that
the root of a large component is likely to be the least of any key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import textkit
from quarrylight.llm.common import broadcast_if_small, components, discard, written

#: Keys of a document in the first round of hubs; the number of rounds with all keys.
FIRST_KEYS = 4
HUB_ROUNDS = 2
#: Members of a key that one task compares with one another, on average.
BLOCK = 512
#: Words of them, on average.
BLOCK_WORDS = 1_000_000
#: Pairs of a document from which their common parts are counted by a table of the block.
SEVERAL = 8


@dataclass
class Method:
    keys: Callable[[textkit.Words], np.ndarray]  # band keys (uint64) of each text; 0: it has no key there, nor behind it
    forms: Callable[[textkit.Words], list[np.ndarray]]  # what verification compares (uint32) of each text
    alike: Callable[[np.ndarray, np.ndarray], bool]  # forms of two texts
    near: Callable[[np.ndarray, np.ndarray, int], np.ndarray]  # by parts in common, parts of others and of one: may be alike
    least_length: float  # the shorter text's words as a share of the longer one's, of a pair above the threshold


def _sketches(method: Method):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textkit.chunks(batch):
                w = textkit.words(piece.column("text"))
                keys = method.keys(w)
                off = np.r_[0, np.cumsum((keys > 0).sum(1))].astype(np.int32)
                columns = [*(piece.column(c) for c in ("doc_id", "t1", "t2")), pa.array(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(off), pa.array(keys[keys > 0].view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t1", "t2", "n_words", "keys"])

    return run


def _forms(method: Method):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textkit.chunks(batch):
                w = textkit.words(piece.column("text"))
                yield pa.record_batch([piece.column("doc_id"), pa.array([x.tobytes() for x in method.forms(w)], pa.binary())], names=["id", "form"])

    return run


def _verify(method: Method):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("form_a"), batch.column("form_b")
            hit = [method.alike(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) for x, y in zip(left, right, strict=True)]
            yield pa.record_batch([batch.column("root"), batch.column("hub_root")], names=["node", "parent"]).filter(pa.array(hit, pa.bool_()))

    return run


def _hub_round(members: DataFrame, roots: DataFrame, forms: DataFrame, method: Method) -> DataFrame:
    """roots after each member of (k, id, n_words, root) has been compared with one hub of another root."""
    least = F.min(F.struct("root", F.col("id").alias("hub"), F.col("n_words").alias("hub_words"))).alias("least")
    hubs = members.groupBy("k").agg(least, F.max("root").alias("high")).where("least.root < high").select("k", "least.hub", "least.hub_words", F.col("least.root").alias("hub_root"))
    met = members.join(hubs, "k").where("root <> hub_root").where(_long_enough(method, "n_words", "hub_words"))
    # as many hubs as keys for each id, at most
    chosen = met.groupBy("id").agg(F.min("root").alias("root"), F.mode("hub", True).alias("hub"), F.collect_set(F.struct("hub", "hub_root")).alias("hubs"))
    pairs = chosen.select("id", "root", "hub", F.filter("hubs", lambda x: x["hub"] == F.col("hub"))[0]["hub_root"].alias("hub_root"))
    pairs = written(pairs, "pairs")
    hubs = written(pairs.select("hub").distinct(), "hubs")
    one = forms.toDF("id", "form_a").join(broadcast_if_small(pairs), "id")
    two = forms.toDF("hub", "form_b").join(broadcast_if_small(hubs), "hub", "left_semi")
    texts = one.join(two, "hub").select("root", "hub_root", "form_a", "form_b")
    up = written(texts.mapInArrow(_verify(method), "node long, parent long").groupBy("node").agg(F.min("parent").alias("parent")), "parents")
    for _ in range(2):  # parents are less than their nodes, so there are no circles
        above = up.toDF("parent", "above")
        before, up = up, written(up.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")), "parents")
        discard(before)
    out = written(roots.join(up.toDF("root", "parent"), "root", "left").select("id", F.coalesce("parent", "root").alias("root")), "roots")
    discard(roots, up, pairs, hubs)
    return out


def _long_enough(method: Method, m: str, n: str) -> Column:
    return F.least(m, n) >= F.greatest(m, n) * method.least_length - 1e-9


def _block_links(members: DataFrame, keys: DataFrame, forms: DataFrame, method: Method) -> DataFrame:
    """(a, b): links between roots that join all alike members of a key. members: (k, band, id, n_words, root).

    Members of one root need not be compared, so those of a key's most frequent root are dealt to slices and all others to
    blocks. Each slice meets each block, and each block each other one; a block is compared within itself at the first slice.
    Mostly one block holds the others, and then the frequent root's members are dealt once only, however many they are.
    """
    several = members.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("k")
    home = written(members.join(several, "k"), "met")
    by_root = home.groupBy("k", "root").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    tops = by_root.groupBy("k").agg(F.max(F.struct("n", "w", "root")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    sizes = tops.select("k", F.col("top.root").alias("top"), _blocks(F.col("top.n"), F.col("top.w")).alias("slices"), _blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("blocks"))
    place = F.xxhash64(F.lit(7), "id")
    own = F.when(F.col("root") == F.col("top"), -1 - F.pmod(place, F.col("slices"))).otherwise(F.pmod(place, F.col("blocks"))).cast("int")
    dealt = home.join(sizes, "k").withColumn("own", own)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    in_slice = F.transform(every, lambda b: F.struct(b.alias("i"), F.col("own").alias("j")))
    slices = F.transform(F.sequence(F.lit(1), F.col("slices")), lambda c: F.struct(F.col("own").alias("i"), (-c).alias("j")))
    others = F.transform(F.filter(every, lambda b: b != F.col("own")), lambda b: F.struct(F.least("own", b).alias("i"), F.greatest("own", b).alias("j")))
    spread = dealt.select("k", "band", "id", "n_words", "root", "own", F.explode(F.when(F.col("own") < 0, in_slice).otherwise(F.concat(slices, others))).alias("cell"))
    spread = spread.select("k", "band", "id", "n_words", "root", "own", "cell.i", "cell.j")
    dealt = spread.join(keys, "id").join(forms, "id").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ("k", "i", "j")):
            if len(rows) > 1:
                found = _links(rows, method)
                if found:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    links = written(dealt.mapInArrow(run, "a long, b long"), "links")
    discard(home)
    return links


def _blocks(n: Column, words: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(words / BLOCK_WORDS), F.lit(1)).cast("int")


def _links(rows: pa.Table, method: Method) -> list[tuple[int, int]]:
    ids, root, own, n, band = (rows.column(c).to_numpy().copy() for c in ("id", "root", "own", "n_words", "band"))
    across = rows.column("j")[0].as_py() != -1  # only the first slice compares a block within itself
    forms = [np.frombuffer(x.as_buffer(), np.uint32) for c in rows.column("form").chunks for x in c]
    earlier = np.zeros((len(ids), int(band[0])), np.int64)  # keys of the bands before this one
    for x, k in enumerate(k for c in rows.column("keys").chunks for k in c):
        k = k.values.to_numpy()[: band[0]]
        earlier[x, : len(k)] = k
    size = np.array([len(x) for x in forms])
    parts = None
    found = []
    for x in range(len(ids) - 1):
        m = n[x + 1 :]
        o = root[x + 1 :] != root[x]
        o &= np.minimum(m, n[x]) >= np.maximum(m, n[x]) * method.least_length - 1e-9
        if across:
            o &= own[x + 1 :] != own[x]
        y = x + 1 + np.flatnonzero(o)
        for c in range(0, earlier.shape[1], 8):
            y = y[~(earlier[y, c : c + 8] == earlier[x, c : c + 8]).any(1)]
        if len(y) >= SEVERAL:
            if parts is None:
                first = np.r_[0, np.cumsum(size)]
                _, place = np.unique(textkit.labelled(np.concatenate(forms).astype(np.uint64), first), return_inverse=True)
                parts = np.split(place, first[1:-1])
                mine = np.zeros(len(place), bool)
            mine[parts[x]] = True
            both = np.add.reduceat(mine[np.concatenate([parts[k] for k in y])], np.r_[0, np.cumsum(size[y])[:-1]], dtype=np.int64)
            mine[parts[x]] = False
            y = y[method.near(both, size[y], size[x])]
        for k in y.tolist():
            if root[k] != root[x] and method.alike(forms[x], forms[k]):
                found.append((int(root[x]), int(root[k])))
                root[root == root[k]] = root[x]
    return found


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the columns `by`, from batches in that order. Holds one group at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(n - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cut = np.flatnonzero(change) + 1
        for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, n].tolist(), strict=True):
            now = tuple(c[a] for c in columns)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def classes(docs: DataFrame, method: Method, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id): a row for each row of docs; class_id is the least doc_id of its class.

    Rows with a null doc_id or a null text are in no class with others: class_id is their doc_id. Texts without words are in
    one class with their exact copies only. Rows that repeat a doc_id count as one document that has all their links. No rows:
    no rows. Other columns are ignored, whatever their names.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = plain.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"))
    rows = written(keyed.mapInArrow(_sketches(method), "doc_id long, t1 long, t2 int, n_words long, keys array<bigint>"), "sketches")
    least = F.min(F.struct("doc_id", "n_words", "keys")).alias("least")
    reps = written(rows.groupBy("t1", "t2").agg(least).select("t1", "t2", F.col("least.doc_id").alias("id"), "least.n_words", "least.keys"), "texts")
    every = reps.select("id", "n_words", F.posexplode("keys").alias("band", "key")).select("id", "n_words", "band", F.xxhash64("band", "key").alias("k"))
    shared = every.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    members = written(every.join(shared, "k").select("k", "band", "id", "n_words"), "members")
    candidates = written(members.select("id").distinct(), "candidates")
    forms = keyed.select("doc_id", "text").join(broadcast_if_small(candidates).withColumnRenamed("id", "doc_id"), "doc_id")
    forms = written(forms.mapInArrow(_forms(method), "id long, form binary"), "forms")
    roots = written(candidates.select("id", F.xxhash64("id").alias("root")), "roots")
    roots = _hub_round(members.where(F.col("band") < FIRST_KEYS).withColumn("root", F.xxhash64("id")), roots, forms, method)
    for _ in range(HUB_ROUNDS):
        roots = _hub_round(members.join(broadcast_if_small(roots), "id"), roots, forms, method)
    keys = reps.select("id", "keys").join(candidates, "id", "left_semi")
    links = _block_links(members.join(broadcast_if_small(roots), "id").select("k", "band", "id", "n_words", "root"), keys, forms, method)
    named = written(rows.select("doc_id", "t1", "t2").join(reps.select("t1", "t2", "id"), ["t1", "t2"]).select("doc_id", "id"), "named")
    several = written(named.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("doc_id"), "several")
    if several.head(1):  # rows that repeat a doc_id tie their texts together
        tied = named.join(several, "doc_id").select("id", F.xxhash64("doc_id").alias("b"))
        links = links.union(tied.join(roots, "id", "left").select(F.coalesce("root", F.xxhash64("id")).alias("a"), "b"))
        roots = written(roots.union(tied.select("id", F.xxhash64("id").alias("root")).join(roots.select("id"), "id", "left_anti").distinct()), "roots")
    top = components(links, "a", "b")
    labels = written(roots.join(top.toDF("root", "top"), "root", "left").select("id", F.coalesce("top", "root").alias("label")), "labels")
    heads = labels.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).where("n > 1").select("label", "class_id")
    moved = written(labels.join(heads, "label").where("id <> class_id").select("id", "class_id"), "moved")
    class_of = named.join(broadcast_if_small(moved), "id", "left").select("doc_id", F.coalesce("class_id", "id").alias("class_id")).where("doc_id <> class_id").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    found = written(class_of, "classes")
    discard(rows, reps, members, candidates, forms, roots, named, several, labels, moved)
    out = plain.where("doc_id is not null").select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.union(plain.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id")))
