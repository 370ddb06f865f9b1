"""Near duplicates among embeddings by spherical-cap filters.

A filter is a direction of a structured random product code: a vector is rotated, cut into BLOCKS parts, and each part is met
with WORDS random code words; the concatenations of code words are the filters, WORDS ** BLOCKS for each of CODES independent
codes. A vector goes to every filter that its inner product exceeds by CAP standard deviations; these are list-decoded part by
part, dropping prefixes that the best of the remaining parts can't lift over the bound. Vectors that share a filter are
compared exactly, in double precision.

Measured on random pairs at cosine 0.9 in 64 dimensions, 99 of 100 share a filter; nearer pairs more. A pair that shares
several filters is counted in the least of them only. A filter with many vectors is dealt in blocks of bounded size, each pair
of blocks a piece of work of its own; per vector it returns the count of links and one link towards its component, never the
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import components, written
from quarrylight.llm.similar import groups

BLOCKS = 2
WORDS = 64
CODES = 6
#: Height of the caps in standard deviations of the inner product of a random vector with a filter.
CAP = 3.1
COSINE = 0.9
#: Vectors of a filter that one piece of work holds, on average.
MEMBERS = 512


def filters_of(unit: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for all filters of unit vectors (rows). Where it exceeds no filter of a code, a vector goes to the best one."""
    parts = [_decode(unit, k) for k in range(codes)]
    return np.concatenate([r for r, _ in parts]), np.concatenate([c + k * WORDS**BLOCKS for k, (_, c) in enumerate(parts)])


def _decode(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    n, d = unit.shape
    rng = np.random.default_rng([seed, d])
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = unit @ rotation
    if d % BLOCKS:
        v = np.pad(v, ((0, 0), (0, BLOCKS - d % BLOCKS)))
    width = v.shape[1] // BLOCKS
    words = rng.standard_normal((BLOCKS, WORDS, width))
    words /= np.linalg.norm(words, axis=2, keepdims=True) * np.sqrt(BLOCKS)
    part = np.einsum("nbw,bkw->nbk", v.reshape(n, BLOCKS, width), words)
    best = part.max(2)
    rest = np.cumsum(best[:, ::-1], axis=1)[:, ::-1]  # the most that parts b and later can add
    bound = CAP / np.sqrt(d)
    bound = np.minimum(bound, rest[:, 0] - 1e-12)
    row = np.repeat(np.arange(n), WORDS)
    code = np.tile(np.arange(WORDS), n)
    total = part[:, 0].reshape(-1)
    for b in range(1, BLOCKS):
        keep = total + rest[row, b] >= bound[row]
        row, code, total = row[keep], code[keep], total[keep]
        total = (total[:, None] + part[row, b]).reshape(-1)
        code = (code[:, None] * WORDS + np.arange(WORDS)).reshape(-1)
        row = np.repeat(row, WORDS)
    keep = total >= bound[row]
    return row[keep], code[keep]


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, ids, dims = batch.column("v"), batch.column("id").to_numpy(), batch.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            for i in range(0, len(at), 2000):
                some = at[i : i + 2000]
                row, code = filters_of(_unit(vectors.take(pa.array(some)).to_pylist()))
                order = np.lexsort((code, row))
                off = np.searchsorted(row[order], np.arange(len(some) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.ListArray.from_arrays(pa.array(off), pa.array(code[order].astype(np.int32)))], names=["id", "filters"])


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least index that it is connected with."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(rows: pa.Table, cosine: float) -> pa.RecordBatch:
    rows = rows.sort_by("id")
    ids, own, weight = (rows.column(c).to_numpy() for c in ("id", "own", "size"))
    f, across = rows.column("filter")[0].as_py(), rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    unit = _unit(rows.column("v").to_pylist())
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    if across:
        linked &= own[:, None] != own[None, :]
    if linked.any():
        lists = rows.column("filters").combine_chunks()
        row = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        code = lists.flatten().to_numpy()
        less = code < f
        if less.any():
            kind, at = np.unique(code[less], return_inverse=True)
            holds = np.zeros((len(ids), len(kind)), np.float32)
            holds[row[less], at] = 1
            linked &= holds @ holds.T == 0  # a pair that shares a smaller filter is counted there
    root = _local_roots(linked)
    n = linked @ weight
    some = n > 0
    return pa.record_batch([pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(ids[root[some]])], names=["id", "n", "root"])


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs of other vectors with cosine >= `cosine`.

    Vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing; vectors of different
    lengths don't link. Equal vectors are compared once and counted as often as they stand; rows that repeat a vec_id are
    vectors of their own that share its component. Rows with a null vec_id link with nothing: component_id and kept are null.
    No rows: no rows. Other columns are ignored, whatever their names.
    """
    plain = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    whole = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(whole, F.lit(False))
    keyed = plain.select("vec_id", fine.alias("fine"), F.when(fine, F.transform("v", lambda x: x + F.lit(0.0))).alias("v")).withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    copies = written(keyed.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.any_value("v").alias("v")), "vectors")
    distinct = copies.select("id", "size", "v", F.size("v").alias("dim"), "h1", "h2")
    # rows of one vec_id with different vectors: the hash tells them apart
    node = written(distinct.withColumn("node", F.xxhash64("id", "h1", "h2")), "nodes")
    work = node.select(F.col("node").alias("id"), "size", "v", "dim")
    coded = written(work.select("id", "v", "dim").mapInArrow(_filters, "id long, filters array<int>"), "filters")
    flat = coded.select("id", "filters", F.explode("filters").alias("filter"))
    blocks = flat.groupBy("filter").agg(F.count("*").alias("n")).where("n > 1").select("filter", F.ceil(F.col("n") / MEMBERS).cast("int").alias("n_blocks"))
    # at most a row for each filter: CODES * WORDS ** BLOCKS
    home = flat.join(F.broadcast(blocks), "filter").withColumn("own", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("n_blocks")).cast("int"))
    spread = home.select("id", "filters", "filter", "own", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    spread = spread.select("id", "filters", "filter", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = spread.join(work, "id").repartition("filter", "dim", "i", "j").sortWithinPartitions("filter", "dim", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ("filter", "dim", "i", "j")):
            if len(rows) > 1:
                yield _compare(rows, cosine)

    found = written(dealt.mapInArrow(run, "id long, n long, root long").groupBy("id", "root").agg(F.sum("n").alias("n")), "links")
    names = node.select("node", F.col("id").alias("first"))
    ends = found.where("id <> root").select("id", "root").join(names.toDF("id", "a"), "id").join(names.toDF("root", "b"), "root").select("a", "b")
    own_ids = keyed.where("fine").join(node.select("h1", "h2", F.col("id").alias("first")), ["h1", "h2"])
    same = own_ids.where("vec_id <> first").select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    repeated = keyed.where("fine").groupBy("vec_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").limit(1).count()
    roots = components(ends.union(same) if repeated else ends, "a", "b")
    links = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "node")
    classes = written(node.join(links, "node", "left").join(roots.toDF("id", "root"), "id", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")), "classes")
    linked = keyed.where("fine").select("vec_id", "h1", "h2").join(classes, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    apart = keyed.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(apart).withColumn("kept", F.col("vec_id") == F.col("component_id"))
