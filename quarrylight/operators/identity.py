"""Identities and the life of documents: resolution, redirects, lineages, invariants, revisions; and joins they rest on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import discard, written

#: Lengths of beginnings that notes are filed under are multiples of this.
LEVEL = 40


def resolve(mentions: DataFrame, rules: list[tuple[str, DataFrame]], key: str = "key") -> DataFrame:
    """mentions with target and how: the first rule (kind, frame of key and target) that knows the key. A key with several
    targets in its rule is ambiguous: null target, how = kind + '?'. No rule: how = 'none'. Null keys resolve to nothing."""
    facts = [df.groupBy(key).agg(F.min("target").alias("target"), F.count_distinct("target").alias("n")).select(key, F.lit(i).alias("p"), F.lit(kind).alias("kind"), "target", "n") for i, (kind, df) in enumerate(rules)]
    best = reduce(DataFrame.union, facts).groupBy(key).agg(F.min(F.struct("p", "kind", "target", "n")).alias("b"))
    one = F.col("b.n") == 1
    return mentions.join(best, key, "left").select(*mentions.columns, F.when(one, F.col("b.target")).alias("target"), F.when(F.col("b").isNull(), "none").when(one, F.col("b.kind")).otherwise(F.concat("b.kind", F.lit("?"))).alias("how"))


def follow(links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(source, target, steps): where each redirect ends. Steps double each round for the redirects that have not ended yet, until
    all have or only circles are left; a chain that runs into a circle ends at null. links: one target for each source. What
    has ended is put aside, looked up by the others and not written again."""
    first = links.select(F.col(source).alias("s"), F.col(target).alias("t"), F.lit(1).cast("long").alias("n")).where("s is not null and t is not null")
    first = written(first, "redirects")
    goes_on = first.select(F.col("s").alias("t"), F.lit(True).alias("on"))
    now = written(first.join(goes_on, "t", "left").select("s", "t", "n", F.col("on").isNull().alias("done")), "redirects")
    n_links, reach, ended, kept = now.count(), 1, now.where("done"), [first, now]
    open_ = now.where("not done")
    # once a round began with more steps than there are links, what goes on has come round
    while reach <= 2 * n_links and open_.head(1):
        known = ended.union(open_).select(F.col("s").alias("t"), F.col("t").alias("t2"), F.col("n").alias("n2"), "done")
        now = written(open_.select("s", "t", "n").join(known, "t").select("s", F.col("t2").alias("t"), (F.col("n") + F.col("n2")).alias("n"), "done"), "redirects")
        kept.append(now)
        ended, open_, reach = ended.union(now.where("done")), now.where("not done"), 2 * reach
    out = written(ended.select("s", "t", "n").union(open_.select("s", F.lit(None).cast(first.schema["t"].dataType), F.lit(None).cast("long"))), "ends")
    discard(*kept)
    return out.select(F.col("s").alias(source), F.col("t").alias(target), F.col("n").alias("steps"))


def lineage(links: DataFrame, source: str = "source", target: str = "target", depth: int | None = None) -> DataFrame:
    """(source, ancestor, depth): all that a document replaces, directly or by steps, each ancestor once at its least number of
    steps; with `depth`, no more steps than that. Forks are followed both ways; a document on a circle is not its own ancestor.
    Each round takes up what the last one found anew, so circles end of themselves."""
    step = links.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null and s <> t").distinct()
    step = written(step, "steps")
    now = written(step.select(F.col("s").alias("source"), F.col("t").alias("ancestor"), F.lit(1).alias("depth")), "lineage")
    every, rounds = now, 1
    while (depth is None or rounds < depth) and now.head(1):
        rounds += 1
        further = now.join(step, F.col("ancestor") == F.col("s")).where("t <> source").select("source", F.col("t").alias("ancestor"), F.lit(rounds).alias("depth")).distinct()
        now = written(further.join(every.select("source", "ancestor"), ["source", "ancestor"], "left_anti"), "lineage")
        every = every.union(now)
    return every.select(F.col("source").alias(source), "ancestor", "depth")


def families(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, family): connected components named by their least node. A node points at the least smaller one around it, and
    `follow` finds where that ends. Links that no pointer stands for are made links of those ends, and the same is done with
    them until none is left; each row is written a few times, however long the chains are. links are read twice a round."""
    edges = links.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
    named, first = None, True
    while True:
        near = written(edges.groupBy("a").agg(F.min("b").alias("b"), F.max(F.when(F.col("b") < F.col("a"), F.col("b"))).alias("most")), "pointers")
        ends = follow(near.where("b < a"), "a", "b").select(F.col("a").alias("node"), F.col("b").alias("top"))
        if named is None:
            alone = near.where("b = a").select(F.col("a").alias("node"))  # named by links to themselves, at most
            named = ends.union(ends.select(F.col("top").alias("node")).union(alone).distinct().select("node", F.col("node").alias("top")))
        else:
            above = ends.toDF("top", "higher")
            named = named.join(above, "top", "left").select("node", F.coalesce("higher", "top").alias("top"))
        forks = near.where("most > b").select("a", F.col("b").alias("least"))
        if not forks.head(1):
            return named.toDF("node", "family")
        left = edges.join(forks, "a").where("b < a and b > least").select("a", "b")
        if first:  # ends of links that no pointer goes to
            apart = left.select(F.col("b").alias("node")).distinct().join(named.select("node"), "node", "left_anti")
            named, first = named.union(apart.select("node", F.col("node").alias("top"))), False
        left = left.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b", "left").select("x", F.coalesce("y", "b").alias("y"))
        edges = written(left.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
        if not edges.head(1):
            return named.toDF("node", "family")


def resolve_documents(mentions: DataFrame, registry: DataFrame, row_id: str) -> DataFrame:
    """(row_id, state, document): which registered document a mention is, by hash, then by name.

    mentions: row_id, hash, name, brand; registry: document, hash, name, brand, status. A mention with a brand meets only
    documents of that brand; without one the name says nothing. One active document: active; several: ambiguous; none, but
    others: only_inactive; the first key that knows anything decides. Else no_match. Matches are counted before the join, so a
    key that many documents have costs one row."""
    def facts(keys: list[str]) -> DataFrame:
        live = F.col("status") == "active"
        return registry.groupBy(*keys).agg(F.count_if(live).alias("n"), F.min(F.when(live, F.col("document"))).alias("document"))

    out = mentions.select(row_id, "hash", "name", "brand")
    for i, keys in enumerate((["hash", "brand"], ["hash"], ["name", "brand"])):
        out = out.join(facts(keys).toDF(*keys, f"n{i}", f"d{i}"), keys, "left")
    branded = F.col("brand").isNotNull()
    tries = [(F.when(branded, F.col("n0")).otherwise(F.col("n1")), F.when(branded, F.col("d0")).otherwise(F.col("d1"))), (F.when(branded, F.col("n2")), F.col("d2"))]
    n = F.coalesce(*[t[0] for t in tries])
    found = F.when(tries[0][0].isNotNull(), tries[0][1]).otherwise(tries[1][1])
    state = F.when(n.isNull(), "no_match").when(n == 1, "active").when(n > 1, "ambiguous").otherwise("only_inactive")
    return out.select(row_id, state.alias("state"), F.when(n == 1, found).alias("document"))


def authority(counts: DataFrame) -> Column:
    """Standing of a family by counts of its open, finished and pending documents; the first rule that holds."""
    o, f, p = F.col("n_open"), F.col("n_finished"), F.col("n_pending")
    return (
        F.when(o + f + p == 0, "none")
        .when((o == 1) & (f == 0) & (p == 0), "single_active")
        .when((o == 0) & (f == 1) & (p == 0), "single_superseded")
        .when((o == 0) & (f == 0), "only_pending")
        .when((o == 1) & (f > 0) & (p == 0), "active_with_history")
        .when((o == 1) & (p > 0), "active_with_pending")
        .when((o > 1) & (f == 0) & (p == 0), "several_active")
        .when((o > 1) & (f > 0), "several_active_with_history")
        .when((o > 1) & (p > 0), "several_active_with_pending")
        .when((o == 0) & (f > 1) & (p == 0), "only_superseded")
        .when((o == 0) & (f > 0) & (p > 0), "superseded_with_pending")
        .otherwise("other")
    )


def violations(checks: dict[str, DataFrame], sealed: DataFrame | None = None) -> DataFrame:
    """(invariant, subject): what breaks each invariant, less the sealed exceptions (same columns)."""
    every = reduce(DataFrame.union, [df.toDF("subject").select(F.lit(name).alias("invariant"), F.col("subject").cast("string").alias("subject")) for name, df in checks.items()]).distinct()
    return every if sealed is None else every.join(sealed, ["invariant", "subject"], "left_anti")


def census(checks: dict[str, DataFrame], sealed: DataFrame) -> DataFrame:
    """(invariant, subject, state): `new` for what breaks an invariant and is not sealed, `sealed` for what is, `resolved` for
    sealed exceptions that break nothing any more. The seal is stale if there are any of the last."""
    now = violations(checks).withColumn("now", F.lit(True))
    before = sealed.select("invariant", F.col("subject").cast("string").alias("subject")).distinct().withColumn("before", F.lit(True))
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("sealed")
    return now.join(before, ["invariant", "subject"], "full").select("invariant", "subject", state.alias("state"))


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Keys of rows that no parent has."""
    return rows.select(F.col(key).alias("k")).join(parents.select(F.col(parent_key).alias("k")), "k", "left_anti").distinct()


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)


def revision_parts(name: Column) -> Column:
    """Numbers of a revision mark, in order."""
    return F.transform(F.regexp_extract_all(name, F.lit("[0-9]+"), 0), lambda x: x.cast("long"))


def revision_verdict(rows: DataFrame, family: str, name: str, row_id: str, blocked: Column) -> DataFrame:
    """(row_id, verdict): BLOCKED, else NO_SIGNAL without numbers, else CURRENT if no mark of as many parts in the family is
    larger, SUPERSEDED if one is, NOT_COMPARABLE if the family has marks of other lengths only."""
    t = rows.select(row_id, family, revision_parts(F.col(name)).alias("parts"), F.coalesce(blocked, F.lit(False)).alias("blocked")).withColumn("arity", F.size("parts"))
    tops = t.where("arity > 0 and not blocked").groupBy(family, "arity").agg(F.max("parts").alias("top"), F.count("*").alias("n"))
    totals = tops.groupBy(family).agg(F.sum("n").alias("n_family"))
    j = t.join(tops, [family, "arity"], "left").join(totals, family, "left")
    verdict = F.when(F.col("blocked"), "BLOCKED").when(F.col("arity") == 0, "NO_SIGNAL").when(F.col("parts") < F.col("top"), "SUPERSEDED").when((F.col("n") == 1) & (F.col("n_family") > 1), "NOT_COMPARABLE").otherwise("CURRENT")
    return j.select(row_id, verdict.alias("verdict"))


def neighbours(rows: DataFrame, group: str, position: str, gap: int) -> DataFrame:
    """(group, position, near, distance): rows of one group at a distance of 1 to gap. Each row is dealt to the positions around
    it, so the join is an equality and a long group costs no pairs beyond the gap."""
    around = rows.select(group, F.col(position).alias("near"), F.explode(F.sequence(F.col(position) - gap, F.col(position) + gap)).alias(position)).where(F.col("near") != F.col(position))
    return rows.select(group, position).join(around, [group, position]).withColumn("distance", F.abs(F.col("near") - F.col(position)))


def latest_before(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: Column, within: Column | None = None) -> DataFrame:
    """left with the value of the key's latest right row at or before its time (null if none): both sides are stacked and the
    last value is carried forward in a window, so no pairs are made. value: an expression over right."""
    r = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(value.alias("v"), F.col(right_time).alias("t")).alias("_v"))
    columns = [F.struct(*left.columns).alias("_row")]
    a = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), *columns)
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(r, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_row.*", F.col("_last.v").alias("value"), F.col("_last.t").alias("value_time"))


def matched_by_prefix(notes: DataFrame, log: DataFrame, person: str, note_text: str, log_text: str, log_time: str, log_id: str, note_id: str, length: int = 200) -> DataFrame:
    """(note_id, log_id): for each note the person's latest log row whose text begins with the note's first `length` signs.

    The join is on the person and the beginning. Notes shorter than `length` meet the log by the beginning of their own length.
    A note is filed under its first LEVEL, 2 LEVEL, ... signs, as many of these as it has; a log row is looked up once for each
    such length, and spelled out only for the lengths of notes that begin as it does. Log rows of equal beginnings are one.
    """
    head = notes.select(note_id, F.col(person).alias("p"), F.left(note_text, F.lit(length)).alias("head")).where("head is not null and p is not null")
    n = head.withColumn("size", F.length("head")).withColumn("level", F.floor(F.col("size") / LEVEL).cast("int") * LEVEL)
    levels = [r[0] for r in n.select("level").distinct().collect()]  # length / LEVEL + 1 numbers at most
    filed = n.groupBy("p", "level", F.left("head", F.col("level")).alias("begin")).agg(F.collect_set("size").alias("sizes"))  # LEVEL numbers at most
    l = log.select(F.col(person).alias("p"), F.left(log_text, F.lit(length)).alias("t"), F.struct(F.col(log_time).alias("at"), F.col(log_id).alias("id")).alias("row")).where("p is not null and t is not null")
    l = l.groupBy("p", "t").agg(F.max("row").alias("row")).select("*", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level")).where(F.col("level") <= F.length("t"))
    l = l.withColumn("begin", F.left("t", F.col("level"))).join(filed, ["p", "level", "begin"])
    l = l.select("p", "t", "row", F.explode("sizes").alias("size")).where(F.col("size") <= F.length("t")).withColumn("head", F.left("t", F.col("size")))
    latest = l.groupBy("p", "head").agg(F.max("row").alias("row"))
    return n.join(latest, ["p", "head"]).select(note_id, F.col("row.id").alias(log_id))
