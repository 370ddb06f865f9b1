"""Helpers that the training-data operators share: tables in the shared folder, checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its values take so many bytes at most.
BROADCAST_BYTES = 16 << 20


#: Rows in an Arrow batch: whole texts are long, and a batch stands in memory twice.
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers Spark's default of rows in an Arrow batch; a value that the user chose stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, to be read in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only where the session names none and has no executors on other
    machines (tests); on a cluster the setting is required."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-quarrylight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and a lost executor loses none of it. options: the writer's."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _bytes_of(c: Column, kind: T.DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType):
        each = sum(8 for _ in kind.elementType.fields) + 16 if isinstance(kind.elementType, T.StructType) else 8
        return F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)) * each + 24
    return F.lit(16)


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A broadcast hint if the values of df, in all rows, take `limit` bytes at most; above it Spark shuffles both sides. df
    should be a written table of scalars, strings and arrays of scalars or of structs of scalars."""
    each = [_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    total = df.agg(F.sum(sum(each[1:], each[0]).cast("long")).alias("total")).first()["total"] or 0
    return F.broadcast(df) if total <= (BROADCAST_BYTES if limit is None else limit) else df


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: undirected pairs of ids; null ids and loops are ignored. Returns (node, root): every node that has a link,
    with the smallest id reachable from it. Each round is two aggregations and two joins on node ids, so a node of
    very many links is combined on the map side and its join partition can be split. No links: no rows.
    """
    e = written(
        edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a is not null and b is not null and a <> b").distinct(),
        "edges",
    )
    while not _only_stars(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before, e = e, written(nxt.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", F.col("b").alias("root")).distinct())


def _only_stars(e: DataFrame) -> bool:
    """Whether each node of edges (a, b) is either the centre b of its edges or the end a of one."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").head(1)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
