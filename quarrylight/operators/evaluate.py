"""Retrieval quality: hits, recall, reciprocal rank, agreement, verdicts, intervals, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import written


def retrieval_metrics(hits: DataFrame, gold: DataFrame, k: int, query: str = "query", row_id: str = "id") -> DataFrame:
    """(query, n_gold, hit, recall, rr) at k for every query of gold; a query that finds nothing has zeros. hits: query, id,
    rank; gold: query, id."""
    g = written(gold.select(query, row_id).distinct(), "gold")  # read twice, and often dear to find
    sizes = g.groupBy(query).agg(F.count("*").alias("n_gold"))
    got = hits.where(F.col("rank") <= k).join(g, [query, row_id]).groupBy(query).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    j = sizes.join(got, query, "left")
    return j.select(query, "n_gold", (F.coalesce("n", F.lit(0)) > 0).cast("int").alias("hit"), F.round(F.coalesce("n", F.lit(0)) / F.col("n_gold"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two 0/1 judgements, rows with both; null if chance agreement is 1."""
    c = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count("*").alias("n"), F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("both"), F.count_if((F.col(a) == 0) & (F.col(b) == 0)).alias("neither"), F.count_if(F.col(a) == 1).alias("n_a"), F.count_if(F.col(b) == 1).alias("n_b")
    )
    po = (F.col("both") + F.col("neither")) / F.col("n")
    pe = (F.col("n_a") * F.col("n_b") + (F.col("n") - F.col("n_a")) * (F.col("n") - F.col("n_b"))) / (F.col("n") * F.col("n"))
    return c.select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def rank_shift(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """(query, overlap, median_shift): share of the first k that two lists have in common, and how far common ids moved."""
    a, b = (df.where(F.col("rank") <= k).select("query", "id", F.col("rank").alias(n)) for df, n in ((before, "r1"), (after, "r2")))
    both = a.join(b, ["query", "id"]).groupBy("query").agg(F.count("*").alias("n"), F.round(F.median(F.abs(F.col("r1") - F.col("r2")).cast("double")), 6).alias("median_shift"))
    return before.select("query").distinct().join(both, "query", "left").select("query", F.round(F.coalesce("n", F.lit(0)) / F.lit(float(k)), 6).alias("overlap"), "median_shift")


def majority(votes: DataFrame, by: str, vote: str, worst_first: list[str], least: int = 3) -> DataFrame:
    """(by, n, verdict): the most frequent valid vote, ties to the worst; `error` with fewer than `least` valid ones."""
    valid = votes.where(F.col(vote).isin(*worst_first))
    badness = F.array_position(F.array(*map(F.lit, worst_first)), F.col(vote))
    n = valid.groupBy(by, vote).agg(F.count("*").alias("n"))
    g = n.groupBy(by).agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("c"), badness.alias("w"), F.col(vote).alias("v"))).alias("top"))
    return votes.select(by).distinct().join(g, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) < least, "error").otherwise(F.col("top.v")).alias("verdict"))


def pair_class(a: Column, b: Column) -> Column:
    """Outcome of a pair: better, worse or same of b against a; broken if either is missing."""
    return F.when(a.isNull() | b.isNull(), "broken").when(b > a, "better").when(b < a, "worse").otherwise("same")


def bootstrap_mean(rows: DataFrame, by: str, value: str, row_id: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(by, n, mean, low, high): mean and the 2.5 and 97.5 percentiles of resampled means.

    A resample draws each row a Poisson(1) number of times, decided by seed, row_id and the resample's number alone, so the
    result doesn't depend on how rows lie in partitions, and a group's rows need not meet: each task adds up weighted sums, and
    only these are shuffled. Null values are left out."""
    ready = rows.select(F.col(by).cast("string").alias("g"), F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), row_id).alias("h")).where("v is not null and g is not null")
    gold, turn = np.uint64(0x9E3779B97F4A7C15), np.arange(1, resamples + 1, dtype=np.uint64)
    bounds = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))  # of Poisson(1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = f["h"].to_numpy().view(np.uint64)[:, None] + turn[None, :] * gold
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            w = np.searchsorted(bounds, (x >> np.uint64(11)) / 2.0**53, side="right")
            v = f["v"].to_numpy()
            for g, at in f.groupby("g", sort=True).indices.items():
                yield pd.DataFrame({"g": g, "i": np.arange(resamples), "s": v[at] @ w[at], "w": w[at].sum(0).astype(float)})

    sums = ready.mapInPandas(run, "g string, i int, s double, w double").groupBy("g", "i").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    means = sums.select("g", F.try_divide("s", "w").alias("m")).groupBy("g").agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))
    plain = ready.groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    return plain.join(means, "g").select(F.col("g").alias(by), "n", "mean", "low", "high")


def bootstrap_delta(rows: DataFrame, by: str, a: str, b: str, row_id: str, resamples: int = 1000, seed: int = 43) -> DataFrame:
    """The same for the paired difference b - a; rows that lack either are left out."""
    return bootstrap_mean(rows.withColumn("_delta", F.col(b).cast("double") - F.col(a).cast("double")), by, "_delta", row_id, resamples, seed)


def overall(outcomes: DataFrame, outcome: str, tolerance: int = 0) -> DataFrame:
    """(better, worse, same, broken, verdict) of all pairs: b wins or loses if its lead is more than the tolerance; any broken
    pair makes the comparison invalid."""
    n = outcomes.agg(*[F.count_if(F.col(outcome) == x).alias(x) for x in ("better", "worse", "same", "broken")])
    lead = F.col("better") - F.col("worse")
    return n.withColumn("verdict", F.when(F.col("broken") > 0, "invalid").when(lead > tolerance, "better").when(lead < -tolerance, "worse").otherwise("same"))


def gap_class(rank: Column, top: int = 5) -> Column:
    """Where an answer got lost: its evidence was on top (generation), in the list (top_k), or not found (retrieval)."""
    return F.when(rank.isNull(), "retrieval").when(rank <= top, "generation").otherwise("top_k")


def funnel_class(in_top: Column, in_pool: Column, in_corpus: Column) -> Column:
    """The last stage that a fact reached."""
    return F.when(in_top, "synthesis").when(in_pool, "rerank_miss").when(in_corpus, "retrieval").otherwise("corpus_gap")


def fact_present(anchors: Column, overlap: Column, answer_tokens: Column, least: float = 0.8) -> Column:
    """Whether an answer has a fact: all of its distinctive values, or, where it has none, `least` of its words; null if it has
    neither (for a person to judge)."""
    return F.when(F.size(anchors) > 0, F.size(F.array_except(anchors, answer_tokens)) == 0).when(overlap.isNotNull(), overlap >= least)


def behaviour(answer: Column, asks: str, admits: str, head: int = 300) -> Column:
    """clarify, admit or answer, by what the answer's first signs say; asks, admits: patterns over lower case."""
    first = F.lower(F.left(answer, F.lit(head)))
    return F.when(answer.contains("?") & first.rlike(asks), "clarify").when(first.rlike(admits), "admit").otherwise("answer")


def answer_verdict(contradicted: Column, invented: Column, n_scored: Column, n_present: Column, behaved: Column) -> Column:
    """The first fault that holds: contradiction, fabrication, not evaluable, wrong behaviour, incomplete; else pass."""
    return F.when(contradicted, "contradiction").when(invented, "fabrication").when(n_scored == 0, "not_evaluable").when(~behaved, "behaviour").when(n_present < n_scored, "incomplete").otherwise("pass")


def stratified_sample(rows: DataFrame, stratum: str, row_id: str, size: int, seed: str = "s") -> DataFrame:
    """About `size` rows in proportion to the strata: floors first, then one more for the largest remainders (ties by name). Within
    a stratum the order is the md5 of seed and id. A stratum's rows are ranked after a cut by quota: no more than that is kept."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    q = counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") * size / F.col("total")).withColumn("base", F.floor("share"))
    left = q.withColumn("order", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("share") - F.col("base"), 9)), stratum))).withColumn("room", size - F.sum("base").over(Window.partitionBy(F.lit(1))))
    quota = left.select(stratum, (F.col("base") + (F.col("order") <= F.col("room")).cast("int")).alias("quota"))
    draw = F.md5(F.concat(F.lit(seed), F.col(row_id).cast("string")))
    w = Window.partitionBy(stratum).orderBy(draw, row_id)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).join(quota, stratum).where(F.col("_n") <= F.col("quota")).select(stratum, row_id)
