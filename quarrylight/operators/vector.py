"""Vector search and de-duplication within a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Queries that one pass over the rows scores at once; a larger query set takes more passes.
QUERY_BLOCK = 2048
#: Similarities that a task holds at once.
CELLS = 1 << 19
#: Vectors of a group in a block of pairs, on average, and how many of them one product takes at once.
BLOCK = 2048
STRIPE = 256


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.5, row_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", where: Column | None = None, same: str | None = None) -> DataFrame:
    """(query_id, row_id, similarity, rank): for each query the k rows of largest cosine above the threshold (strictly).

    Ties go to the smaller row id. `where` filters rows; with `same`, a row must agree with its query in that column (nulls
    agree with nothing). A task keeps the k best of each query, so what is shuffled does not depend on the rows' number times the
    queries', scores at most CELLS pairs at once, and the query block that goes to all tasks is bounded.
    """
    base = rows if where is None else rows.where(where)
    spark = rows.sparkSession
    n = queries.count()
    passes = max(1, -(-n // QUERY_BLOCK))
    out = None
    for p in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == p)
        got = part.select(query_id, vector, *([same] if same else [])).toArrow()
        sent = spark.sparkContext.broadcast(got)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            if not q.num_rows:
                return
            names = q.column(query_id).to_numpy()
            unit = _unit(q.column(vector).to_pylist())
            labels = np.array(q.column(same).to_pylist(), object) if same else None
            best = np.full((len(names), 0), -2.0), np.zeros((len(names), 0), np.int64)  # of each query so far: similarity, row
            step = max(1, CELLS // max(1, len(names)))
            for batch in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
                ids = batch.column(row_id).to_numpy(zero_copy_only=False)
                s = unit @ _unit(batch.column(vector).to_pylist(), unit.shape[1]).T
                if same:
                    own = np.array(batch.column(same).to_pylist(), object)
                    s = np.where((own[None, :] == labels[:, None]) & (own[None, :] != None), s, -2)  # noqa: E711
                best = _best(*best, s, ids, k, threshold)
            of, at = np.nonzero(best[0] > threshold)
            yield pa.record_batch([pa.array(names[of]), pa.array(best[1][of, at]), pa.array(best[0][of, at])], names=[query_id, row_id, "similarity"])

        columns = [row_id, vector, *([same] if same else [])]
        found = base.where(F.col(vector).isNotNull() & F.col(row_id).isNotNull()).select(*columns).mapInArrow(run, f"{query_id} long, {row_id} long, similarity double")
        out = found if out is None else out.union(found)
    w = Window.partitionBy(query_id).orderBy(F.desc(F.round("similarity", 12)), row_id)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(s0: np.ndarray, id0: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each line of s0 and s over the threshold, with their ids, largest first; equal to 12 places: the smaller id."""
    least = s0[:, k - 1 : k] if s0.shape[1] >= k else np.full((len(s), 1), -np.inf)
    of, at = np.nonzero((s > threshold) & (np.round(s, 12) >= np.round(least, 12)))
    had_of, had_at = np.nonzero(s0 > threshold)
    line, value, row = np.r_[had_of, of], np.r_[s0[had_of, had_at], s[of, at]], np.r_[id0[had_of, had_at], ids[at]]
    order = np.lexsort((row, -np.round(value, 12), line))
    line, value, row = line[order], value[order], row[order]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    top, name = np.full((len(s), k), -2.0), np.zeros((len(s), k), np.int64)
    keep = place < k
    top[line[keep], place[keep]], name[line[keep], place[keep]] = value[keep], row[keep]
    return top, name


def _unit(vectors: list, width: int | None = None) -> np.ndarray:
    """Rows of length one; zeros for null, zero or unsound vectors and those of another width."""
    width = width or max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width and None not in v:
            out[i] = v
    out[~np.isfinite(out).all(1)] = 0
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def keep_max_by_parent(hits: DataFrame, parent: Column, query_id: str = "query_id", score: str = "similarity", row_id: str = "vec_id") -> DataFrame:
    """Surrogate hits collapse to their parents: the best score of each, and the surrogate that has it."""
    best = F.max(F.struct(F.round(score, 6).alias("s"), (-F.col(row_id)).alias("r")))
    return hits.groupBy(query_id, parent.alias("parent_id")).agg(best.alias("b"), F.count("*").alias("n_hits")).select(query_id, "parent_id", F.col("b.s").alias("similarity"), (-F.col("b.r")).alias("via"), "n_hits")


def pairs_in_groups(rows: DataFrame, group: str, threshold: float, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(group, a, b, similarity): pairs of one group with cosine at or above the threshold, a < b; cosine as in `functions.vectors`,
    rounded to 6 places.

    A group is dealt in blocks of about BLOCK vectors, each pair of blocks a piece of work of its own: a product of matrices in
    double precision, of which only the pairs found leave the task. The work grows with the square of a group, what is shuffled
    with its size times its number of blocks.
    """
    sound = F.col(group).isNotNull() & F.col(row_id).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    ready = rows.where(sound).select(F.col(group).alias("g"), F.col(row_id).alias("id"), F.col(vector).alias("v"), F.size(vector).alias("dim"))
    large = ready.groupBy("g", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")).where("n_blocks > 1")
    # `large` has less than a row for every BLOCK vectors
    blocks = ready.join(F.broadcast(large), ["g", "dim"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    spread = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    spread = spread.select("g", "id", "v", "dim", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # with the number of tasks named, adaptive execution doesn't join pieces of few bytes and much work
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(tasks, "g", "dim", "i", "j").sortWithinPartitions("g", "dim", "i", "j", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("g", "dim", "i", "j")):
            ids, own = t.column("id").to_numpy(), t.column("own").to_numpy()
            m = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
            half = int((own == own[0]).sum()) if across else 0
            if across and half == len(ids):
                continue  # the other block is empty
            with np.errstate(all="ignore"):
                length = np.sqrt(np.einsum("nd,nd->n", m, m))
                left, right = (np.arange(half), np.arange(half, len(ids))) if across else (np.arange(len(ids)),) * 2
                for a in range(0, len(left), STRIPE):
                    some = left[a : a + STRIPE]
                    scale = length[some, None] * length[None, right]
                    s = np.divide(m[some] @ m[right].T, scale, out=np.zeros_like(scale), where=scale != 0)
                    x, y = np.nonzero(~(s < threshold - 1e-6))  # the last place is Spark's to round
                    p, q, s = ids[some[x]], ids[right[y]], s[x, y]
                    once = p != q if across else p < q
                    p, q, s = p[once], q[once], s[once]
                    yield pa.record_batch([t.column("g").combine_chunks().take(pa.array(np.zeros(len(p), np.int64))), pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(s)], names=["g", "a", "b", "s"])

    kind, key = ready.schema["id"].dataType, ready.schema["g"].dataType
    found = dealt.mapInArrow(run, StructType().add("g", key).add("a", kind).add("b", kind).add("s", "double"))
    return found.select(F.col("g").alias(group), "a", "b", F.round("s", 6).alias("similarity")).where(F.col("similarity") >= threshold)


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the columns `by`, from batches in that order; one at a time."""
    held, key = [], None
    for batch in batches:
        columns = [batch.column(c) for c in by]
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(change) + 1
        for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, batch.num_rows].tolist(), strict=True):
            if a == b:
                continue
            now = tuple(c[a].as_py() for c in columns)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def greedy_dedup(rows: DataFrame, group: str, threshold: float = 0.94, row_id: str = "vec_id", vector: str = "embedding", prefer: Column | None = None) -> DataFrame:
    """(row_id, duplicate_of): in order of preference, then id, a row whose cosine with a kept row of its group reaches the
    threshold is that row's duplicate (the first such); others are kept (null).

    A group's rows reach one task in order, but only kept vectors stand in memory. Rows with null groups or vectors are kept.
    """
    order = [*([prefer.alias("_prefer")] if prefer is not None else [F.lit(0).alias("_prefer")])]
    ready = rows.select(F.col(row_id).cast("long").alias("row_id"), F.xxhash64(group).alias("g"), F.col(vector).alias("v"), *order).where(F.col(group).isNotNull() & F.col(vector).isNotNull())
    dealt = ready.repartition("g").sortWithinPartitions("g", "_prefer", "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, kept = None, [], np.zeros((0, 0))
        for batch in batches:
            ids, out = batch.column("row_id").to_pylist(), []
            for i, g, v in zip(ids, batch.column("g").to_pylist(), batch.column("v").to_pylist(), strict=True):
                u = _unit([v])[0]
                if g != now:
                    now, names, kept = g, [], np.zeros((16, len(u)))
                s = kept[: len(names)] @ u if len(u) == kept.shape[1] else np.zeros(len(names))
                hit = np.flatnonzero(np.round(s, 12) >= threshold)
                out.append(names[hit[0]] if len(hit) else None)
                if not len(hit) and len(u) == kept.shape[1]:
                    if len(names) == len(kept):
                        kept = np.concatenate([kept, np.zeros_like(kept)])
                    kept[len(names)] = u
                    names.append(i)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], names=[row_id, "duplicate_of"])

    found = dealt.mapInArrow(run, f"{row_id} long, duplicate_of long")
    rest = rows.where(F.col(group).isNull() | F.col(vector).isNull()).select(F.col(row_id).cast("long").alias(row_id), F.lit(None).cast("long").alias("duplicate_of"))
    return found.union(rest)
