"""The dispatch store as a Python data source: JSON objects by name, each from the first of several roots that has it.

    register(spark)
    spark.read.format("dispatch").option("roots", "file:///disk;file:///bucket").option("names", "a;b").load()

A row: name, root (number of the root that had the object; null if none), content (the text), bytes. The names are listed from the roots
unless the option `names` gives them; then names that no root has come back with null content, or end the read with
`missing=error`. Filters on `name` (equal, in) are pushed down: only those objects are opened. Reads are dealt to `partitions`
tasks of about as many bytes; a task opens its own objects, so nothing passes through the driver but names and sizes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "name string, root int, content string, bytes long"
END = ".json"


class MissingObject(RuntimeError):
    """No root has a name that was asked for."""


class BrokenObject(RuntimeError):
    """An object is no JSON text."""


def _root(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place)


@dataclass
class _Piece(InputPartition):
    names: list[tuple[str, int]]  # with the root that has each, -1 for none


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r for r in options.get("roots", "").split(";") if r]
        if not self.roots:
            raise ValueError("name the roots, separated by semicolons")
        self.asked = [n for n in options["names"].split(";") if n] if options.get("names") is not None else None
        self.partitions_wanted = int(options.get("partitions", 8))
        self.missing = options.get("missing", "null")
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self._keep({f.value})
            elif isinstance(f, In) and f.attribute == ("name",):
                self._keep(set(f.value))
            else:
                yield f

    def _keep(self, names: set[str]) -> None:
        self.only = names if self.only is None else self.only & names

    def _listed(self) -> dict[str, tuple[int, int]]:
        """Root and size of every object, by name; the first root that has it."""
        found: dict[str, tuple[int, int]] = {}
        for i, place in enumerate(self.roots):
            system, path = _root(place)
            for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if x.is_file and x.base_name.endswith(END):
                    found.setdefault(x.base_name.removesuffix(END), (i, x.size))
        return found

    def partitions(self) -> list[InputPartition]:
        found = self._listed()
        names = sorted(set(self.asked if self.asked is not None else found))
        if self.only is not None:
            names = [n for n in names if n in self.only]
        if self.missing == "error" and (gone := [n for n in names if n not in found]):
            raise MissingObject(f"no root has {gone[:5]}")
        parts: list[list[tuple[str, int]]] = [[] for _ in range(max(1, min(self.partitions_wanted, len(names))))]
        held = [0] * len(parts)
        for n in sorted(names, key=lambda n: -found.get(n, (0, 0))[1]):  # the largest first, to the emptiest
            k = held.index(min(held))
            root, size = found.get(n, (-1, 0))
            parts[k].append((n, root))
            held[k] += size + 1
        return [_Piece(p) for p in parts]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        systems = [_root(p) for p in self.roots]
        kind = pa.schema([("name", pa.string()), ("root", pa.int32()), ("content", pa.string()), ("bytes", pa.int64())])
        for name, root in partition.names:
            if root < 0:
                yield pa.record_batch([[name], [None], [None], [None]], schema=kind)
                continue
            data, used = self._content(systems, name, root)
            try:
                json.loads(data)
            except ValueError as error:
                raise BrokenObject(f"{name} in root {used}: {error}") from error
            yield pa.record_batch([[name], [used], [data.decode()], [len(data)]], schema=kind)

    @staticmethod
    def _content(systems: list[tuple[fs.FileSystem, str]], name: str, root: int) -> tuple[bytes, int]:
        """The object, from a later root if it has gone from the one that was seen to hold it."""
        for i in range(root, len(systems)):
            system, path = systems[i]
            try:
                with system.open_input_stream(f"{path}/{name}{END}") as f:
                    return f.read(), i
            except FileNotFoundError:
                continue
        raise MissingObject(f"no root has {name} any more")


class DispatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dispatch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DispatchSource)
