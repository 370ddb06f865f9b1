"""Usage reports over `events`: who asked, what failed, how long it took, what people said of it.

Roles: an event is a logged turn; `error` is a failed turn; `value` its latency; `purchase` a positive and `signup` a prose
feedback; the number in `props` names channel, reason and stage. Each report is one or two aggregations with map-side partial
sums; ratios guard against empty denominators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = ("web", "bot", "mail")


def day(ts: str = "ts") -> Column:
    return F.date_format(F.col(ts), "yyyy-MM-dd")


def week(ts: str = "ts") -> Column:
    """Monday of the week."""
    return F.date_format(F.date_trunc("week", F.col(ts)), "yyyy-MM-dd")


def key_number(props: str = "props") -> Column:
    """The number `k` of the JSON in props; null where the JSON is broken or has none."""
    return F.get_json_object(props, "$.k").try_cast("long")


def channel(k: Column) -> Column:
    return F.when(k.isNull(), "unknown").when(k % 4 == 3, "other").otherwise(F.element_at(F.array(*map(F.lit, CHANNELS)), (k % 4 + 1).cast("int")))


def health(events: DataFrame, period: Column) -> DataFrame:
    """Per period: turns, failures, people, median and 95th percentile latency of turns that did not fail."""
    fine = F.col("event_type") != "error"
    return events.groupBy(period.alias("period")).agg(
        F.count("*").alias("n"),
        F.count_if(~fine).alias("n_errors"),
        F.count_distinct(F.when(fine, F.col("user_id"))).alias("people"),
        F.round(F.percentile(F.when(fine, F.col("value")), 0.5), 6).alias("p50"),
        F.round(F.percentile(F.when(fine, F.col("value")), 0.95), 6).alias("p95"),
        F.round(F.try_divide(F.count_if(~fine) * F.lit(100.0), F.count("*")), 1).alias("error_share"),
    )


def usage_by_channel(events: DataFrame) -> DataFrame:
    return events.groupBy(week().alias("week"), channel(key_number()).alias("channel")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("people"))


def feedback(events: DataFrame) -> DataFrame:
    """Weekly votes and weekly prose, each week that has either."""
    votes = events.where(F.col("event_type").isin("purchase", "error")).groupBy(week().alias("week")).agg(F.count_if(F.col("event_type") == "purchase").alias("positive"), F.count_if(F.col("event_type") == "error").alias("negative"))
    prose = events.where("event_type = 'signup'").groupBy(week().alias("week")).agg(F.count("*").alias("prose"))
    both = votes.join(prose, "week", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("week", zero("positive"), zero("negative"), zero("prose"), F.round(F.try_divide(F.col("positive") * F.lit(100.0), F.col("positive") + F.col("negative")), 1).alias("approval"))


def negative_reasons(events: DataFrame) -> DataFrame:
    k = key_number()
    reason = F.coalesce(F.when(k < 30, "wrong").when(k < 60, "incomplete").when(k < 90, "off_topic"), F.lit("unstated"))
    return events.where("event_type = 'error'").groupBy(week().alias("week"), reason.alias("reason")).agg(F.count("*").alias("n"))


def channel_health(events: DataFrame) -> DataFrame:
    """Share of turns whose trace has a number, and of those that name the first channel."""
    k = key_number()
    shaped = F.get_json_object("props", "$.k").isNotNull() & (F.octet_length("props") <= 8192)
    g = events.groupBy(day().alias("day")).agg(F.count("*").alias("n"), F.count_if(shaped).alias("n_traced"), F.count_if(shaped & (k % 4 == 0)).alias("n_first"))
    return g.withColumn("first_share", F.round(F.try_divide(F.col("n_first") * F.lit(100.0), F.col("n_traced")), 1))


def stage_latency(events: DataFrame) -> DataFrame:
    """Percentiles of two stages and their sum over the same turns: those where both numbers are sound."""
    k = key_number()
    t = events.select("event_type", F.col("value").alias("total"), k.cast("double").alias("first")).where("total is not null and first is not null and total >= 0 and first between 0 and 100")
    names = {"total": F.col("total"), "first": F.col("first"), "rest": F.col("total") - F.col("first")}
    stats = [F.round(F.percentile(c, q), 6).alias(f"{n}_p{int(q * 100)}") for n, c in names.items() for q in (0.5, 0.95)]
    return t.groupBy("event_type").agg(F.count("*").alias("n"), *stats)


def exploded_mentions(events: DataFrame) -> DataFrame:
    """Weekly count of each mentioned value, and of the people who mention it."""
    k = key_number()
    mentions = F.array_distinct(F.array_compact(F.array(F.col("event_type"), channel(k), F.when(k >= 50, "high"))))
    return events.select(week().alias("week"), "user_id", F.explode(mentions).alias("mention")).groupBy("week", "mention").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("people"))


def explorer(events: DataFrame, since: str, kind: str | None = None, least: float | None = None, cap: int = 500) -> DataFrame:
    """Rows of a window in time, newest first; each filter counts only if it is given."""
    out = events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if kind is not None:
        out = out.where(F.col("event_type") == kind)
    if least is not None:
        out = out.where(F.col("value") >= least)
    return out.orderBy(F.desc("ts"), "event_id").limit(cap)


def coverage(rows: DataFrame, classified: DataFrame, key: str, by: str) -> DataFrame:
    """How many rows have a classification, per group; and the rows that still wait."""
    got = classified.select(key, F.lit(True).alias("hit"), "quality")
    return rows.join(got, key, "left").groupBy(by).agg(F.count("*").alias("n"), F.count("hit").alias("classified"), F.count_if(F.col("hit").isNull()).alias("pending"), F.min("quality").alias("least"), F.max("quality").alias("most"))


def pending(rows: DataFrame, classified: DataFrame, key: str) -> DataFrame:
    """Rows without a classification: what the next pass takes up."""
    return rows.join(classified, key, "left_anti")


def person_activity(people: DataFrame, orders: DataFrame, events: DataFrame) -> DataFrame:
    """Each person with counts of orders and events, zero where there are none."""
    o = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    e = events.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
    j = people.join(o, people["c_custkey"] == o["o_custkey"], "left").join(e, people["c_custkey"] == e["user_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("c_custkey", zero("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"), zero("events"), zero("errors"))


def retention(events: DataFrame, cutoff: str, salt: str = "pepper") -> DataFrame:
    """Rows older than the cut-off lose the person's id for a keyed pseudonym; `retention_receipt` counts them."""
    old = F.col("ts") < F.lit(cutoff).cast("timestamp_ntz")
    return events.select("event_id", F.when(~old, F.col("user_id")).alias("user_id"), F.when(old, F.sha2(F.concat(F.lit(salt), F.col("user_id").cast("string")), 256)).alias("pseudonym"))


def retention_receipt(events: DataFrame, cutoff: str) -> DataFrame:
    """What a retention pass changes: rows and people by day."""
    return events.where(F.col("ts") < F.lit(cutoff).cast("timestamp_ntz")).groupBy(day().alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("people"))


def still_identified(people: DataFrame, *evidence: DataFrame) -> DataFrame:
    """People whom some table still names. evidence: one-column frames of ids."""
    every = evidence[0].toDF("id")
    for e in evidence[1:]:
        every = every.union(e.toDF("id"))
    return people.join(every, people["c_custkey"] == every["id"], "left_semi")


def throttle_wait(failures: Column, base: float = 2.0, most: float = 900.0) -> Column:
    """Seconds to wait after so many failures in a row: base * 2^(n - 1), at most `most`."""
    return F.when(failures <= 0, 0.0).otherwise(F.least(F.lit(most), base * F.pow(F.lit(2.0), failures - 1)))


def digest(events: DataFrame, internal: DataFrame) -> DataFrame:
    """Daily turns, failures and people, without those of internal users. internal: one column of ids."""
    return events.join(internal.toDF("user_id"), "user_id", "left_anti").groupBy(day().alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_distinct("user_id").alias("people"))


def feedback_by_type(events: DataFrame) -> DataFrame:
    """Weekly votes by channel, beside all turns of that week and channel."""
    keys = [week().alias("week"), channel(key_number()).alias("channel")]
    votes = events.where(F.col("event_type").isin("purchase", "error")).groupBy(*keys).agg(F.count_if(F.col("event_type") == "purchase").alias("positive"), F.count_if(F.col("event_type") == "error").alias("negative"))
    turns = events.groupBy(*keys).agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return turns.join(votes, ["week", "channel"], "left").select("week", "channel", "n", zero("positive"), zero("negative"))


def remapped(value: Column, names: dict[str, str]) -> Column:
    """Names of an old taxonomy replaced; others stay."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), value)


def work_state(status: Column, until: Column, due: Column, now: Column, patience: float) -> Column:
    """What a poll should do with a piece of work: `reclaimable` if its lease ran out, `stuck` if it ran out long ago, `due` if
    it waits and its time has come (no time: at once), else `wait` or `done`."""
    late = F.unix_timestamp(now) - F.unix_timestamp(until)
    return F.when(status == "done", "done").when((status == "running") & (late > patience), "stuck").when((status == "running") & (late > 0), "reclaimable").when((status == "waiting") & (due.isNull() | (due <= now)), "due").otherwise("wait")


def classified(answer: Column, allowed: list[int]) -> Column:
    """A classifier's JSON, strictly: null unless it parses and its category `k` is allowed; a missing flag counts as true."""
    got = F.from_json(answer, "k bigint, flag boolean")
    return F.when(got["k"].isin(*allowed), F.struct(got["k"].alias("k"), F.coalesce(got["flag"], F.lit(True)).alias("flag")))
