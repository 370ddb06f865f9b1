"""Stateful streams whose state ends: throttles, leases and quotas on event-time timers, deliveries by an outer join of streams.

The processors keep a few values for each key and set timers on the watermark; what a timer finds expired is removed, and
leases that ran out are reported. They need Spark's RocksDB state store:
`spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylight.operators.gate import Gate, Throttle

MS = 1000


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The rows of a key in a micro-batch."""
    frames = [r for r in rows if len(r)]
    return pd.concat(frames).sort_values(by, kind="stable") if frames else pd.DataFrame(columns=by)


class _Throttled(StatefulProcessor):
    """State: failures and last time of each key of a zone, at most `cap` keys. A timer goes off when the oldest is to be
    forgotten."""

    def __init__(self, rule: Throttle):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tries = handle.getMapState("tries", "key string", "failures int, last double")

    def _load(self) -> dict[str, tuple[int, float]]:
        return {k[0]: (v[0], v[1]) for k, v in self.tries.iterator()} if self.tries.exists() else {}

    def _save(self, before: dict, after: dict) -> None:
        for k in before.keys() - after.keys():
            self.tries.removeKey((k,))
        for k, v in after.items():
            if before.get(k) != v:
                self.tries.updateValue((k,), v)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if after:
            self.handle.registerTimer(int((min(last for _, last in after.values()) + self.rule.retention) * MS) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        gate = Gate(self.rule, before := self._load())
        batch = _ordered(rows, ["at", "seq"])
        waits = [gate.admit(r.at, list(r.keys)) for r in batch[["at", "keys"]].itertuples(index=False)]
        self._save(before, gate.tries)
        if len(batch):
            yield pd.DataFrame({"zone": key[0], "seq": batch["seq"], "at": batch["at"], "wait": waits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gate = Gate(self.rule, before := self._load())
        gate.forget(timerValues.getCurrentWatermarkInMs() / MS)
        self._save(before, gate.tries)
        return iter(())

    def close(self) -> None:
        pass


def throttled(requests: DataFrame, rule: Throttle, late: str = "10 minutes") -> DataFrame:
    """(zone, seq, at, wait) for a stream of (zone, seq, ts, keys): seconds that a request has to wait, 0 if it was let in.

    ts is the event time (timestamp), at the same in seconds. Requests of a zone are taken in order of time within a
    micro-batch; those behind the watermark are dropped by Spark. A zone whose keys are all forgotten has no state."""
    timed = requests.withWatermark("ts", late).withColumn("at", F.col("ts").cast("double"))
    return timed.groupBy("zone").transformWithStateInPandas(_Throttled(rule), "zone string, seq long, at double, wait double", "append", "eventTime")


class _Leased(StatefulProcessor):
    """State: fencing token, holder, end and status of a conversation's lease. A timer goes off at the end of a lease, which is
    then reported and free, and `keep` seconds after the work was done or last touched, when the state goes."""

    def __init__(self, ttl: float, keep: float):
        self.ttl, self.keep = ttl, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "token long, holder string, until double, status string, touched double")

    def _save(self, token: int, holder: str, until: float, status: str, touched: float) -> None:
        self.lease.update((int(token), holder, float(until), status, float(touched)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((until if status == "running" else touched + self.keep) * MS) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        token, holder, until, status, touched = self.lease.get() if self.lease.exists() else (0, "", 0.0, "free", 0.0)
        out = []
        for r in _ordered(rows, ["at", "seq"]).itertuples():
            if status == "running" and r.at >= until:
                out.append((key[0], until, "expired", holder, True, token, "free"))
                status = "free"
            mine = status == "running" and holder == r.holder and token == r.token
            if r.request == "claim":
                granted = status == "free"
                if granted:
                    token, holder, until, status = token + 1, r.holder, r.at + self.ttl, "running"
            else:
                granted = mine and r.request in ("heartbeat", "complete", "fail")
                if granted:
                    until = r.at + self.ttl if r.request == "heartbeat" else 0.0
                    status = {"heartbeat": "running", "complete": "done", "fail": "free"}[r.request]
            touched = max(touched, r.at)
            out.append((key[0], r.at, r.request, r.holder, bool(granted), int(token), status))
        if out:
            self._save(token, holder, until, status, touched)
            yield _lease_rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.lease.exists():
            return
        token, holder, until, status, touched = self.lease.get()
        if status == "running":
            self._save(token, holder, until, "free", max(touched, until))
            yield _lease_rows([(key[0], until, "expired", holder, True, int(token), "free")])
        else:
            self.lease.clear()

    def close(self) -> None:
        pass


def _lease_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv", "at", "request", "holder", "granted", "token", "status"])


def leases(requests: DataFrame, ttl: float = 30.0, keep: float = 86_400.0, late: str = "10 minutes") -> DataFrame:
    """(conv, at, request, holder, granted, token, status) for a stream of (conv, seq, ts, request, holder, token).

    A claim is granted if no live lease stands and the work isn't done; it raises the fencing token. Heartbeat, complete and fail
    need the live lease, its holder and its token; other requests are refused. A lease that runs out is reported once as
    `expired`, by the next request or by its timer, and can be claimed anew. The state of a conversation that nothing touched
    for `keep` seconds ends."""
    timed = requests.withWatermark("ts", late).withColumn("at", F.col("ts").cast("double"))
    out = "conv string, at double, request string, holder string, granted boolean, token long, status string"
    return timed.groupBy("conv").transformWithStateInPandas(_Leased(ttl, keep), out, "append", "eventTime")


class _Counted(StatefulProcessor):
    """State: requests of a person on a day so far, until the day is past the watermark."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["seq"])
        before = self.used.get()[0] if self.used.exists() else 0
        if not len(batch):
            return
        if not before:
            self.handle.registerTimer(int(pd.Timestamp(key[1], tz="UTC").timestamp() + 86_400) * MS)
        self.used.update((int(before + len(batch)),))
        yield pd.DataFrame({"person": key[0], "day": key[1], "seq": batch["seq"], "allowed": [before + i < self.limit for i in range(len(batch))]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def daily_quota(requests: DataFrame, limit: int, late: str = "10 minutes") -> DataFrame:
    """(person, day, seq, allowed) for a stream of (person, seq, ts): the first `limit` requests of a person on a day (UTC session)."""
    timed = requests.withWatermark("ts", late).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return timed.groupBy("person", "day").transformWithStateInPandas(_Counted(limit), "person string, day string, seq long, allowed boolean", "append", "eventTime")


def deliveries(messages: DataFrame, attempts: DataFrame, horizon: str = "1 hour", most: int = 5, late: str = "10 minutes") -> DataFrame:
    """(key, at, n_attempts, status) of each message once its horizon has passed: `delivered`, `dead` after `most` failures, or
    `due`. messages: (key, at), unique by key; attempts: (key, tried_at, ok); both times are timestamps.

    A stream-stream outer join: a message waits for attempts within its horizon, attempts for messages that come late; both
    states end with the watermarks, so an attempt beyond the horizon counts no more. Batch frames work alike."""
    m, a = messages, attempts.withColumnRenamed("key", "tried_key")
    if messages.isStreaming:
        m, a = m.withWatermark("at", late), a.withWatermark("tried_at", late)
    within = (F.col("key") == F.col("tried_key")) & (F.col("tried_at") >= F.col("at")) & (F.col("tried_at") <= F.col("at") + F.expr(f"INTERVAL {horizon}"))
    each = m.join(a, within, "leftOuter").groupBy("key", F.window("at", "1 microsecond").alias("w")) if messages.isStreaming else m.join(a, within, "left").groupBy("key", F.struct(F.col("at").alias("start")).alias("w"))
    counts = each.agg(F.count("tried_at").alias("n_attempts"), F.max(F.coalesce(F.col("ok"), F.lit(False)).cast("int")).alias("ok"))
    status = F.when(F.col("ok") == 1, "delivered").when(F.col("n_attempts") >= most, "dead").otherwise("due")
    return counts.select("key", F.col("w.start").alias("at"), "n_attempts", status.alias("status"))
