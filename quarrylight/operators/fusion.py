"""Ranked lists: fusion, merging, quotas, filters that open when they would leave too little, diversification, reranking.

A list is a DataFrame (query, id, score, rank). Everything is windows over one query's candidates, whose number the channels
bound; queries are the partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import fresh

COLUMNS = ("query", "id", "score", "rank")


def as_list(rows: DataFrame, query: str, row_id: str, score: Column, k: int) -> DataFrame:
    """The k best rows of each query as a list; ties by id. Only the three columns it needs are sorted."""
    w = Window.partitionBy("query").orderBy(F.desc("by"), "id")
    lean = rows.select(F.col(query).alias("query"), F.col(row_id).alias("id"), score.alias("by"))
    return lean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", F.round("by", 6).alias("score"), "rank")


def stacked(lists: dict[str, DataFrame]) -> DataFrame:
    """All lists, with channel and its precedence (0 first)."""
    parts = [df.select(*COLUMNS, F.lit(name).alias("channel"), F.lit(i).alias("precedence")) for i, (name, df) in enumerate(lists.items())]
    return reduce(DataFrame.unionByName, parts)


def reciprocal_rank(lists: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """(query, id, score, rank): sum of 1 / (k + rank); ties by where the id was seen first, then id."""
    g = stacked(lists).groupBy("query", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("precedence", F.col("rank").alias("r"))).alias("seen"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "seen", "id")
    return g.withColumn("rank", F.row_number().over(w)).select(*COLUMNS)


def merge_stamps(lists: dict[str, DataFrame]) -> DataFrame:
    """One row for each id: the record of the first channel that has it; by score, ties by channel and rank."""
    one = Window.partitionBy("query", "id").orderBy("precedence")
    kept = stacked(lists).withColumn("n", F.row_number().over(one)).where("n = 1")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "precedence", F.col("rank"), "id")
    return kept.withColumn("place", F.row_number().over(w)).select("query", "id", "score", "channel", "place")


def merge_quota(lexical: DataFrame, vector: DataFrame, cap: int) -> DataFrame:
    """All lexical ids, and vector ids up to `cap` in all; an id of both keeps the vector record."""
    marked = stacked({"vector": vector, "lexical": lexical})
    lex = F.max(F.when(F.col("channel") == "lexical", 1).otherwise(0)).over(Window.partitionBy("query", "id"))
    one = Window.partitionBy("query", "id").orderBy("precedence")
    kept = marked.withColumn("in_lexical", lex).withColumn("n", F.row_number().over(one)).where("n = 1")
    w = Window.partitionBy("query").orderBy(F.desc("in_lexical"), F.col("rank"), "id")
    return kept.withColumn("place", F.row_number().over(w)).where((F.col("in_lexical") == 1) | (F.col("place") <= cap)).select("query", "id", "score", "channel", "place")


def merge_rescored(lists: dict[str, DataFrame], scores: DataFrame) -> DataFrame:
    """All ids with the score that `scores` (query, id, rescored) has for them, else the one they came with."""
    kept = merge_stamps(lists).drop("place").join(scores, ["query", "id"], "left").withColumn("score", F.coalesce("rescored", "score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return kept.withColumn("place", F.row_number().over(w)).select("query", "id", "score", "channel", "place")


def reserve_quota(main: DataFrame, surrogates: DataFrame, size: int, quota: int = 6, least: float = 0.4) -> DataFrame:
    """Up to `quota` surrogate parents of score `least` or more have places in a pool of `size`.

    A parent that the main list has already keeps the larger score and takes no place; the rest take places at the end."""
    s = surrogates.where(F.col("score") >= least).groupBy("query", "id").agg(F.max("score").alias("extra"))
    new = s.join(main.select("query", "id"), ["query", "id"], "left_anti")
    w = Window.partitionBy("query").orderBy(F.desc("extra"), "id")
    new = new.withColumn("n", F.row_number().over(w)).where(F.col("n") <= quota)
    taken = new.groupBy("query").agg(F.count("*").alias("taken"))
    stay = main.join(taken, "query", "left").where(F.col("rank") <= size - F.coalesce("taken", F.lit(0)))
    first = stay.join(s, ["query", "id"], "left").select("query", "id", F.greatest("score", F.coalesce("extra", "score")).alias("score"), F.lit("main").alias("part"), F.col("rank").alias("place"))
    last = new.join(stay.groupBy("query").agg(F.max("rank").alias("base")), "query", "left").select("query", "id", F.col("extra").alias("score"), F.lit("surrogate").alias("part"), (F.coalesce("base", F.lit(0)) + F.col("n")).alias("place"))
    return first.unionByName(last)


def carve_out(main: DataFrame, extras: list[tuple[DataFrame, int]], size: int) -> DataFrame:
    """The main list cut to size minus what the extras bring, then each extra list's first rows (new ids only)."""
    out = None
    known = main.select("query", "id")
    for part, (rows, quota) in enumerate(extras, 1):
        fresh = rows.join(known, ["query", "id"], "left_anti")
        w = Window.partitionBy("query").orderBy("rank", "id")
        fresh = fresh.withColumn("n", F.row_number().over(w)).where(F.col("n") <= quota).select("query", "id", "score", F.lit(part).alias("part"), "n")
        known = known.union(fresh.select("query", "id"))
        out = fresh if out is None else out.union(fresh)
    brought = out.groupBy("query").agg(F.count("*").alias("b"))
    head = main.join(brought, "query", "left").where(F.col("rank") <= size - F.coalesce("b", F.lit(0))).select("query", "id", "score", F.lit(0).alias("part"), F.col("rank").alias("n"))
    every = head.union(out)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("part", "n"))).select("query", "id", "score", "part", "place")


def extend(pool: DataFrame, more: DataFrame, n: int) -> DataFrame:
    """The pool as it is, then up to n new ids of the other list."""
    w = Window.partitionBy("query").orderBy("rank", "id")
    fresh = more.join(pool.select("query", "id"), ["query", "id"], "left_anti").withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    ends = pool.groupBy("query").agg(F.max("rank").alias("base"))
    tail = fresh.join(ends, "query", "left").select("query", "id", "score", (F.coalesce("base", F.lit(0)) + F.col("n")).cast("int").alias("rank"))
    return pool.select(*COLUMNS).union(tail)


def filter_open(rows: DataFrame, keep: Column, by: str, least: int = 1, unlabelled: Column | None = None) -> DataFrame:
    """Rows that satisfy `keep`; a group in which fewer than `least` rows do stays as it was; null is a group too. A null
    predicate is not satisfied. Rows for which `unlabelled` holds count as satisfying it: what has no label is not hidden."""
    ok = F.coalesce(keep, F.lit(False))
    if unlabelled is not None:
        ok = ok | F.coalesce(unlabelled, F.lit(False))
    group, n = fresh("group", rows), fresh("n", rows)
    counts = rows.groupBy(F.col(by).alias(group)).agg(F.count_if(ok).alias(n))
    return rows.join(counts, rows[by].eqNullSafe(counts[group])).where(ok | (F.col(n) < least)).drop(n, group)


def round_robin(rows: DataFrame, query: str, source: str, order: list[Column], k: int, cap: int | None = None) -> DataFrame:
    """k rows of each query, the sources taking turns in the order of their best rows; a source gives `cap` (default k / 3)
    rows at most unless the others can't fill the k."""
    cap = cap or max(1, k // 3)
    per = Window.partitionBy(query, source).orderBy(*order)
    n = rows.withColumn("turn", F.row_number().over(per)).where(F.col("turn") <= k)
    best = Window.partitionBy(query).orderBy(*order)
    ranked = n.withColumn("_place", F.row_number().over(best)).withColumn("_lead", F.min("_place").over(Window.partitionBy(query, source)))
    w = Window.partitionBy(query).orderBy((F.col("turn") > cap), "turn", "_lead")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("_place", "_lead")


def rerank(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """k candidates of each query by the scorer's score; those it has none for follow in their order, marked `padded`. A query
    with k candidates or fewer keeps its order, marked `short`."""
    j = candidates.join(scores, ["query", "id"], "left").withColumn("n", F.count("*").over(Window.partitionBy("query")))
    short = F.col("n") <= k
    w = Window.partitionBy("query").orderBy(F.when(short, 0).otherwise(F.col("rescored").isNull().cast("int")), F.when(short, F.lit(None)).otherwise(-F.col("rescored")), "rank", "id")
    how = F.when(short, "short").when(F.col("rescored").isNull(), "padded").otherwise("scored")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query", "id", "place", how.alias("how"))


def budgeted(rows: DataFrame, by: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """The first rows of each group whose sizes together stay within the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def complement(candidates: DataFrame, picked: int = 2, redundancy: float = 0.12) -> DataFrame:
    """(query, id, place): rows picked one after another by score minus `redundancy` times the share of their terms that were
    picked already. candidates: query, id, score, terms (array<string>). Two steps of windows for each pick, no Python."""
    left = candidates.withColumn("have", F.array().cast("array<string>"))
    out = None
    for place in range(1, picked + 1):
        common = F.size(F.array_intersect("terms", "have")) / F.greatest(F.size(F.array_distinct("terms")), F.lit(1))
        value = F.round(F.col("score") - redundancy * common, 9)
        w = Window.partitionBy("query").orderBy(F.desc(value), "id")
        placed = left.withColumn("_n", F.row_number().over(w))
        best = placed.where("_n = 1").select("query", "id", F.lit(place).alias("place"))
        out = best if out is None else out.union(best)
        whole = Window.partitionBy("query")
        gain = F.max(F.when(F.col("_n") == 1, F.col("terms"))).over(whole)
        left = placed.withColumn("have", F.array_union("have", gain)).where("_n > 1").drop("_n")
    return out


def reserve_one(pool: DataFrame, rows: DataFrame, wanted: Column, order: list[Column]) -> DataFrame:
    """The pool, and at its end one row at most that is `wanted`, if the pool has none of these."""
    marked = rows.where(wanted)
    have = pool.join(marked.select("query", "id"), ["query", "id"], "left_semi").select("query").distinct()
    w = Window.partitionBy("query").orderBy(*order)
    new = marked.join(have, "query", "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    ends = pool.groupBy("query").agg(F.max("rank").alias("_base"))
    return pool.select(*COLUMNS).union(new.join(ends, "query").select("query", "id", "score", (F.col("_base") + 1).cast("int").alias("rank")))


def diverse(rows: DataFrame, query: str, need: str, source: str, order: list[Column], sources: int = 2, per_need: int = 2, total: int = 6) -> DataFrame:
    """Up to `per_need` rows for each need of a query, from its `sources` best sources, one after another; `total` in all, needs
    taking turns."""
    per = Window.partitionBy(query, need, source).orderBy(*order)
    best = Window.partitionBy(query, need).orderBy(*order)
    r = rows.withColumn("_turn", F.row_number().over(per)).where(F.col("_turn") <= per_need).withColumn("_place", F.row_number().over(best))
    r = r.withColumn("_lead", F.min("_place").over(Window.partitionBy(query, need, source)))
    r = r.withColumn("_source", F.dense_rank().over(Window.partitionBy(query, need).orderBy("_lead"))).where(F.col("_source") <= sources)
    r = r.withColumn("turn", F.row_number().over(Window.partitionBy(query, need).orderBy("_turn", "_lead"))).where(F.col("turn") <= per_need)
    r = r.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("turn", need)))
    return r.where(F.col("place") <= total).drop("_turn", "_place", "_lead", "_source")


def searched(rows: DataFrame, by: list[Column], active: Column, limit: int, factor: int = 3) -> DataFrame:
    """A content search's rows: the first limit * factor in the order `by`, of these active ones first, `limit` in all."""
    return rows.orderBy(*by).limit(limit * factor).orderBy((~F.coalesce(active, F.lit(False))).cast("int"), *by).limit(limit)


def best_of(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order of several keys, with `place`."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
