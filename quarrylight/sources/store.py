"""Several tables under one manifest: a change of all of them is seen whole or not at all.

A store is a folder with `data`, where every write goes under a new name, and `manifest`, where numbered JSON files say which
written folders make up each table. A change is staged (written, named by nothing), may be validated, and is published by
writing the next manifest under a temporary name and renaming it; the rename fails if that number exists, so of two writers
that began from the same state the second is told. Readers take the highest number. What failed before the rename leaves
files that no manifest names and `sweep` deletes; earlier generations stay readable until then.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another change was published since this one began."""


@dataclass
class Staged:
    """A change that no reader sees yet."""

    base: int
    tables: dict[str, list[str]]
    receipt: dict
    written: list[str] = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._java = spark._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self._java.Path("/".join([self.folder, *parts]))

    @property
    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        place = self._path(name)
        return sorted(s.getPath().getName() for s in self._files.listStatus(place)) if self._files.exists(place) else []

    def generation(self) -> int:
        """Number of the newest manifest; 0 for a new store."""
        return max([0, *(int(n[:-5]) for n in self._listed("manifest") if n.endswith(".json") and n[:-5].isdigit())])

    def manifest(self, generation: int | None = None) -> dict:
        """{tables: {name: [folders]}, receipt: {...}} of a generation, the newest if none is named."""
        number = self.generation() if generation is None else generation
        if not number:
            return {"tables": {}, "receipt": {}}
        opened = self._files.open(self._path("manifest", f"{number:010d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode())
        finally:
            opened.close()

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        """A table of a generation. All parts of a table have the same columns."""
        parts = self.manifest(generation)["tables"][table]
        return self.spark.read.parquet(*[f"{self.folder}/data/{p}" for p in parts])

    def stage(self, change: dict[str, DataFrame], append: dict[str, DataFrame] | None = None, receipt: dict | None = None, partition_by: dict[str, str] | None = None) -> Staged:
        """Writes tables that take the place of those of the same name, and parts that are added to them."""
        base = self.generation()
        tables = {k: list(v) for k, v in self.manifest(base)["tables"].items()}
        out = Staged(base, tables, receipt or {})
        try:
            for added, group in ((False, change), (True, append or {})):
                for name, df in group.items():
                    part = f"{name}-{uuid.uuid4().hex}"
                    out.written.append(part)
                    writer = df.write
                    if name in (partition_by or {}):
                        writer = writer.partitionBy(partition_by[name])
                    writer.parquet(f"{self.folder}/data/{part}")
                    tables[name] = [*(tables.get(name, []) if added else []), part]
        except BaseException:
            self.discard(out)
            raise
        return out

    def staged(self, change: Staged, table: str) -> DataFrame:
        """A table as it will be once the change is published."""
        return self.spark.read.parquet(*[f"{self.folder}/data/{p}" for p in change.tables[table]])

    def publish(self, change: Staged) -> int:
        """Makes a staged change the newest generation and gives its number; Conflict if another came first."""
        text = json.dumps({"tables": change.tables, "receipt": change.receipt}, sort_keys=True)
        aside, number = self._path("manifest", f".{uuid.uuid4().hex}"), change.base + 1
        out = self._files.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._java.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        kinds = getattr(self._java, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(kinds, 0)
        try:
            context.rename(context.makeQualified(aside), context.makeQualified(self._path("manifest", f"{number:010d}.json")), none)
        except Exception as error:
            self._files.delete(aside, False)
            if self.generation() != change.base:
                raise Conflict(f"generation {number} was published by another writer") from error
            raise
        return number

    def commit(self, change: dict[str, DataFrame], **more) -> int:
        return self.publish(self.stage(change, **more))

    def discard(self, change: Staged) -> None:
        """Deletes what a change wrote; nothing that a reader sees is touched."""
        for part in change.written:
            self._files.delete(self._path("data", part), True)

    def sweep(self, keep: int = 1) -> list[str]:
        """Deletes written folders that none of the newest `keep` generations names, and older manifests. Not to be run while
        another writer stages."""
        newest = self.generation()
        kept = range(max(1, newest - keep + 1), newest + 1)
        named = {p for g in kept for parts in self.manifest(g)["tables"].values() for p in parts}
        gone = [p for p in self._listed("data") if p not in named]
        for p in gone:
            self._files.delete(self._path("data", p), True)
        for n in self._listed("manifest"):
            if not (n[:-5].isdigit() and int(n[:-5]) in kept):
                self._files.delete(self._path("manifest", n), False)
        return gone
