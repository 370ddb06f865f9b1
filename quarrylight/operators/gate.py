"""The throttle at a gate: how long a request has to wait after the failures of its keys; for streams and for replays of logs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Throttle:
    """After `free` tries a key waits base * 2^(tries - free - 1) seconds, at most `most`, from its last try on. Keys not tried for
    `retention` seconds are forgotten; of more than `cap` keys of a zone the longest untried go."""

    free: int = 5
    base: float = 2.0
    most: float = 900.0
    retention: float = 86_400.0
    cap: int = 10_000


@dataclass
class Gate:
    """The keys of one zone: tries and last time of each."""

    rule: Throttle
    tries: dict[str, tuple[int, float]]

    def __post_init__(self):
        self.tries = dict(self.tries)

    def admit(self, at: float, keys: list[str]) -> float:
        """0 if the request is let in, which counts as a try of all its keys; else the seconds to wait, and nothing is counted."""
        if len(keys) > self.rule.cap:
            raise ValueError(f"{len(keys)} keys, but the zone holds {self.rule.cap}")
        wait = max([0.0, *(self._wait(at, *self.tries[k]) for k in keys if k in self.tries)])
        if wait > 0:
            return wait
        self.forget(at)
        over = len(self.tries.keys() | set(keys)) - self.rule.cap
        if over > 0:
            others = sorted((last, k) for k, (_, last) in self.tries.items() if k not in keys)
            for _, k in others[:over]:
                del self.tries[k]
        for k in set(keys):
            self.tries[k] = self.tries.get(k, (0, 0.0))[0] + 1, at
        return 0.0

    def _wait(self, at: float, tries: int, last: float) -> float:
        if tries <= self.rule.free:
            return 0.0
        return last - at + min(self.rule.base * 2.0 ** min(tries - self.rule.free - 1, 60), self.rule.most)

    def forget(self, at: float) -> None:
        self.tries = {k: v for k, v in self.tries.items() if v[1] >= at - self.rule.retention}


def replay(requests: DataFrame, rule: Throttle) -> DataFrame:
    """(zone, seq, at, wait) of a log of (zone, seq, at, keys): what each request would have had to wait. A zone's requests are
    taken in order of (at, seq); a task holds the keys of one zone, never its requests. Null zones and times are left out."""
    ready = requests.select("zone", "seq", "at", "keys").where("zone is not null and at is not null").repartition("zone").sortWithinPartitions("zone", "at", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zone, gate = None, None
        for batch in batches:
            waits = []
            for z, at, keys in zip(batch.column("zone").to_pylist(), batch.column("at").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                if gate is None or z != zone:
                    zone, gate = z, Gate(rule, {})
                waits.append(gate.admit(at, [k for k in keys or [] if k is not None]))
            yield pa.record_batch([batch.column("zone"), batch.column("seq"), batch.column("at"), pa.array(waits, pa.float64())], names=["zone", "seq", "at", "wait"])

    return ready.mapInArrow(run, "zone string, seq long, at double, wait double")
