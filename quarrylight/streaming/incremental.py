"""Incremental classification as a `foreachBatch` sink: idempotent by batch id, two queues, one call of the classifier a row.

The sink's store holds `rows` (all that came in, once each) and `results` (one part for each pass). What a pass adds and the
number of its batch are published together, so a batch that the stream replays after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import discard, written
from quarrylight.sources.store import Store


@dataclass
class Classification:
    """store: where rows and results are kept. classify: rows -> rows with `label`, every row once. taxonomy: its version.
    limit: rows that one pass classifies at most (None: all); the rest waits for the next."""

    store: Store
    classify: Callable[[DataFrame], DataFrame]
    taxonomy: int
    limit: int | None = None
    key: str = "id"
    order: str = "created_at"

    def results(self) -> DataFrame:
        """(key, label, taxonomy, pass): the newest result of each row."""
        newest = F.max_by(F.struct("label", "taxonomy", "pass"), F.col("pass")).alias("r")
        return self.store.read("results").groupBy(self.key).agg(newest).select(self.key, "r.*")

    def _has(self, table: str) -> bool:
        return table in self.store.manifest()["tables"]

    def waiting(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The two queues of rows: never classified, by age; classified under an older taxonomy, by the age of that result."""
        if not self._has("results"):
            return rows, rows.limit(0).withColumn("pass", F.lit(0))
        done = self.results()
        old = done.where(F.col("taxonomy") < self.taxonomy).select(self.key, "pass")
        return rows.join(done.select(self.key), self.key, "left_anti"), rows.join(old, self.key)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """One pass; give it to `foreachBatch`. Null and repeated keys of a batch: the first are left out, of the others the
        oldest row is taken; keys seen before are not taken anew."""
        receipt = self.store.manifest()["receipt"]
        if receipt.get("batch", -1) >= batch_id:
            return
        new = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min_by(F.struct(*batch.columns), F.col(self.order)).alias("r")).select("r.*")
        rows = self.store.read("rows") if self._has("rows") else None
        if rows is not None:
            new = new.join(rows.select(self.key), self.key, "left_anti")
        new = written(new, "new-rows")
        rows = new if rows is None else rows.unionByName(new)
        never, old = self.waiting(rows)
        number = self.store.generation() + 1
        if self.limit is None:
            todo = written(never.unionByName(old.drop("pass")), "todo")
        else:
            first = written(never.orderBy(self.order, self.key).limit(self.limit), "never-classified")
            left = self.limit - first.count()  # at most `limit`
            todo = written(first.unionByName(old.orderBy("pass", self.order, self.key).limit(left).drop("pass")), "todo")
            discard(first)
        found = self.classify(todo).select(self.key, "label", F.lit(self.taxonomy).alias("taxonomy"), F.lit(number).alias("pass"))
        staged = self.store.stage({}, append={"rows": new, "results": found}, receipt={"batch": batch_id, "taxonomy": self.taxonomy})
        self.store.publish(staged)
        discard(new, todo)
