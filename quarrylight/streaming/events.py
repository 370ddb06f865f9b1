"""Event-time windows, ingress de-duplication and the outbox; `stateful` has what keeps state of its own.

The window functions take batch and streaming frames alike. Event times of type timestamp_ntz are cast, as watermarks need
`timestamp`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None, ts: str = "ts") -> DataFrame:
    """events with ts as a timestamp, and a watermark if `late` is given."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late else out


def tumbling(events: DataFrame, width: str = "1 hour", by: str = "event_type") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(_stamp("w.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", by: str = "event_type") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("most")).select(_stamp("w.start").alias("start"), by, "n", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(_stamp("w.start").alias("start"), _stamp("w.end").alias("end"), by, "n")


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def first_seen(updates: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Ingress: an update is let in once for its key; repeats within the watermark are ignored. Batch: plain de-duplication."""
    if not updates.isStreaming:
        return updates.dropDuplicates(keys)
    return updates.dropDuplicatesWithinWatermark(keys)


def outbox(messages: DataFrame, attempts: DataFrame, most: int = 5) -> DataFrame:
    """(key, n_attempts, status) of outbox messages, unique by key: delivered, dead after `most` failures, else due."""
    a = attempts.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("ok").cast("int")).alias("ok"))
    j = messages.dropDuplicates(["key"]).join(a, "key", "left")
    n = F.coalesce("n", F.lit(0))
    return j.select("key", n.alias("n_attempts"), F.when(F.col("ok") == 1, "delivered").when(n >= most, "dead").otherwise("due").alias("status"))
