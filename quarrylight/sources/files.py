"""Readers and writers: JSON lines, page records, byte inventory, upserts, versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: dict[str, object] | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Parquet with projection, equality filters (None: no filter) and an optional ordered limit."""
    df = spark.read.parquet(path)
    for name, value in (where or {}).items():
        if value is not None:
            df = df.where(F.col(name) == value)
    if order:
        df = df.orderBy(order)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_checked_lines(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines): a line is broken if it is no JSON of the schema or lacks the key."""
    raw = spark.read.text(path).select("value", F.from_json("value", schema).alias("r"))
    ok = F.col("r").isNotNull() & F.col(f"r.{key}").isNotNull()
    return raw.where(ok).select("r.*"), raw.where(~ok).select("value")


def write_sorted_lines(df: DataFrame, path: str, key: str, files: int = 1) -> None:
    """JSON lines in key order, so that equal tables give equal files. Keys must be unique and not null."""
    bad = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n").__gt__(1) | F.col(key).isNull()).limit(1).count()
    if bad:
        raise ValueError(f"{key} is null or repeated")
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(record, page, md, text) of extraction records: one row for each page of each record."""
    schema = "id string, result struct<pages: array<struct<page: int, md: string, text: string, confidence: double>>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.col("id").alias("record"), F.explode("result.pages").alias("p")).select("record", "p.page", "p.md", "p.text", "p.confidence")


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(sha256, canonical, n_files, n_bytes, paths): files grouped by content; canonical is the least path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("content", 256).alias("sha256"), "path", "length").groupBy("sha256").agg(F.min("path").alias("canonical"), F.count("*").alias("n_files"), F.max("length").alias("n_bytes"), F.sort_array(F.collect_list("path")).alias("paths"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in the place of those with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def updated(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old with the columns of changes laid over it where they are not null; other rows as they were."""
    c = changes.select(F.col(key), *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    j = old.join(c, key, "left")
    return j.select(*[F.coalesce(f"_{x}", x).alias(x) if f"_{x}" in c.columns else F.col(x) for x in old.columns])


def deleted(old: DataFrame, where: Column) -> DataFrame:
    """old without the rows that satisfy `where`; rows for which it is null stay."""
    return old.where(~F.coalesce(where, F.lit(False)))


def replace_documents(spark: SparkSession, rows: DataFrame, path: str, partition: str) -> None:
    """Idempotent reload: the partitions that rows has are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


class Generations:
    """A table in versions: rows are written under a new name, validated, and made active by a small pointer table; earlier
    versions are retired but stay readable. The pointer is one row, written whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/versions/{name}")
        return name

    def read(self, name: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/versions/{name or self.active()}")

    def faults(self, name: str, key: str, parent: str | None = None) -> DataFrame:
        """(fault, subject): null or repeated keys; parents that don't exist or have parents themselves."""
        t = self.read(name)
        found = t.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n").__gt__(1) | F.col(key).isNull()).select(F.lit("key").alias("fault"), F.col(key).cast("string").alias("subject"))
        if parent:
            up = t.select(F.col(key).alias("_k"), F.col(parent).alias("_grand"))
            chained = t.where(F.col(parent).isNotNull()).join(up, t[parent] == up["_k"], "left").where(F.col("_k").isNull() | F.col("_grand").isNotNull())
            found = found.union(chained.select(F.lit("parent"), t[key].cast("string")))
        return found

    def publish(self, name: str, key: str, parent: str | None = None) -> None:
        if bad := self.faults(name, key, parent).limit(5).collect():
            raise ValueError(f"not published: {[tuple(r) for r in bad]}")
        self.spark.range(1).select(F.lit(name).alias("name")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/active")

    def active(self) -> str:
        return self.spark.read.parquet(f"{self.root}/active").first()["name"]
