"""Mixing a corpus to target weights by iterative proportional fitting.

Token weights of the cells (source x language x topic) are raked to target marginals: in turn each axis's weights are scaled
so that their sums meet the axis's targets. No cell can give more tokens than it has: such a cell counts as what it has, and
the others of its row are scaled to the rest. Rounds go on until all marginals agree with the targets. A document is then
sampled with the calibrated probability of its cell, decided by a hash of its id. Everything runs as DataFrame operations; the
cells, not the documents, are what the rounds work on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import broadcast_if_small, discard, fresh, written

#: Rounds end when on each axis the misplaced tokens are at most this share of the sample, or, where the targets can't all be
#: met by the cells there are, after ROUNDS.
TOLERANCE = 1e-3
ROUNDS = 40
#: Share of all tokens that the mixture aims at.
BUDGET = 0.5
#: Default target of an axis: shares in proportion to tokens to this power, so that large values give way to small ones.
SOFTEN = 0.7
#: A cell is used up from this share of its tokens on: the last bits of a sum decide nothing.
USED_UP = 1 - 1e-9
NONE = "(none)"
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
LEGAL = ("licensed under", "all rights reserved", "general public license", "mit license")


def n_tokens(text: Column) -> Column:
    """White-space words; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A rule by layout: legal notices, tables, lists of contacts, symbol-ridden text, numbers, prose. First rule wins."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    legal = [F.lower(t).contains(x) for x in LEGAL]
    return (
        F.when(legal[0] | legal[1] | legal[2] | legal[3], "legal")
        .when(t.contains(" | "), "table")
        .when(t.contains("@"), "contact")
        .when(t.rlike("[#$%&*]{3}"), "symbols")
        .when(t.rlike("[0-9]"), "figures")
        .otherwise("prose")
    )


def unit_hash(doc_id: Column) -> Column:
    """A number in [0, 1) from the id's digits: the first 32 bits of their md5."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with topic and n_tokens by the rules above; columns of docs with those names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("topic", "n_tokens")]
    return docs.select(*kept, topic(F.col(text)).alias("topic"), n_tokens(F.col(text)).alias("n_tokens"))


def shares(cells: DataFrame, axis: str, soften: float = SOFTEN) -> DataFrame:
    """(axis, share): the default target, tokens ^ soften."""
    return cells.groupBy(axis).agg(F.pow(F.sum("tokens").cast("double"), F.lit(soften)).alias("share"))


def feasible(cells: DataFrame, axis: str, share: DataFrame, budget: float) -> DataFrame:
    """(axis, target): `budget` of all tokens dealt in proportion to share, a value getting no more than the tokens it has."""
    values = written(cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("t")).join(share.toDF(axis, "share"), axis, "left").select(axis, "t", F.coalesce("share", F.lit(0.0)).alias("share")), "values")
    start = values.agg((F.sum("t") * budget).alias("goal"), F.sum("share").alias("share")).first()
    goal, unit = start["goal"] or 0.0, 0.0
    new = goal / start["share"] if start["share"] else 0.0
    while new > unit:  # each step finds more values that are used up
        unit = new
        full = F.col("share") * unit >= F.col("t")
        left = values.agg(F.sum(F.when(full, F.col("t")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("share")).first()
        new = (goal - left["full"]) / left["share"] if left["share"] else unit
    return values.select(axis, F.least("t", F.col("share") * unit).alias("target"))


def _scaled(cells: DataFrame, axis: str) -> DataFrame:
    """One step: weights of each value of the axis scaled to its target, cells that are used up left out."""
    full = F.col("weight") >= F.col("tokens") * USED_UP
    goal = F.col(f"target_{axis}")
    sums = cells.groupBy(axis).agg(
        F.min(goal).alias("goal"), F.sum("weight").alias("all"), F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")
    )
    some = F.when((F.col("goal") > F.col("full")) & (F.col("free") > 0), (F.col("goal") - F.col("full")) / F.col("free"))
    factor = sums.select(axis, some.when((F.col("goal") < F.col("full")) | (F.col("free") > 0), F.col("goal") / F.col("all")).otherwise(1.0).alias("factor"))
    return cells.join(factor, axis).withColumn("weight", F.col("weight") * F.col("factor")).select(*cells.columns)


def gap(cells: DataFrame, axes: list[str]) -> float:
    """Of the axis that is worst: tokens that stand in another value than the targets ask, as a share of all in the sample."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value"), F.col(f"target_{a}").alias("target")) for a in axes]))
    by = cells.select(each.alias("x"), F.least("weight", "tokens").alias("w")).groupBy("x.axis", "x.value").agg(F.sum("w").alias("w"), F.min("x.target").alias("target"))
    worst = by.groupBy("axis").agg((F.sum(F.abs(F.col("w") - F.col("target"))) / F.sum("target")).alias("gap")).agg(F.max("gap").alias("gap")).first()
    return worst["gap"] or 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """cells (axes, tokens) with `weight`: the tokens that the sample should have of each cell.

    targets: (axis, share) for each axis; a value without a share gets none, a share without cells is dealt to the others, and
    so is what a value has not enough tokens for. Each round is written to the shared folder: one row for each cell.
    """
    axes = [c for c in cells.columns if c != "tokens"]
    fitted = cells.withColumns({"tokens": F.col("tokens").cast("double"), "weight": F.col("tokens") * budget})
    for a in axes:
        fitted = fitted.join(feasible(cells, a, (targets or {}).get(a) or shares(cells, a), budget).withColumnRenamed("target", f"target_{a}"), a)
    fitted = written(fitted, "raked")
    for _ in range(rounds):
        if gap(fitted, axes) <= tolerance:
            break
        nxt = fitted
        for a in axes:
            nxt = _scaled(nxt, a)
        before, fitted = fitted, written(nxt, "raked")
        discard(before)
    return fitted


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", has_labels: bool = False) -> DataFrame:
    """docs with topic, n_tokens, probability and selected (boolean).

    targets: (value, share) for "source", "lang" or "topic"; the others have the default. Null source or language is a value
    of its own, "(none)". A document without tokens (null or blank text) weighs nothing and gets probability 0. The draw depends
    on the id alone (null: as an empty string), so rows that repeat an id fare alike within a cell. Very long texts are counted
    whole. No rows: no rows. With has_labels docs has topic and n_tokens already (of any labeller) and text isn't read; else
    columns of docs with these names are replaced, as are probability and selected. Other columns stay, whatever their names.
    """
    docs = docs.drop("probability", "selected")
    rows = docs if has_labels else labelled(docs, text)
    axes = {"source": fresh("source_axis", rows), "lang": fresh("lang_axis", rows), "topic": fresh("topic_axis", rows)}
    kept = rows.columns
    rows = rows.select(*kept, *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(axes[a]) for a, c in (("source", source), ("lang", lang), ("topic", "topic"))])
    names = list(axes.values())
    cells = written(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "cells")
    raked = rake(cells, {axes[a]: t for a, t in (targets or {}).items()}, budget)
    chance, p = written(raked.select(*names, F.least(F.lit(1.0), F.col("weight") / F.col("tokens")).alias("probability")), "chances"), fresh("chance", rows)
    joined = rows.join(broadcast_if_small(chance.withColumnRenamed("probability", p)), names, "left")
    chosen = F.when(F.col("n_tokens") > 0, F.coalesce(F.col(p), F.lit(0.0))).otherwise(0.0)
    draw = unit_hash(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return joined.select(*kept, chosen.alias("probability"), (draw < chosen).alias("selected"))
