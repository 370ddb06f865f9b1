"""Source divergence audit: how far the word use of each source lies from that of the other sources of its language.

The tasks that read the texts count them in parts, one row for a (language, term, source) of a part. Spark deals the rows to
shards by the hash of language and term, and DuckDB sums a shard inside its task and tells the terms that are kept. With the
sums of all shards at hand DuckDB then gives each shard's part of the difference of each two sources and the shard's leading
terms of each source. Spark adds the parts and ranks.

The difference of two sources is a sum over all kept terms of the language, also of those that neither has. A source gives a
term that it lacks always the same value, so a shard adds the difference of these two values once for all its terms, what
changes for terms that one source has (by the number of terms of each count), and what changes for terms that both have. No
row is made for a term that a source lacks.

Null text, language and source are the empty string. Rows that repeat a doc_id, or have none, are documents of their own.
Texts may have any length. No documents: no rows. A language without kept terms has `pair` rows of value 0 and no `term`
rows; a source alone in its language has no `pair` rows. Equal values rank by the item's UTF-8 bytes. Other columns are not
read.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm import terms as words
from quarrylight.llm import textkit
from quarrylight.llm.common import written

#: A language keeps a term that so many of its documents hold.
LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
#: Ranks of `term` rows.
TOP = 50
#: Texts counted together, rows of counts summed in the task that made them, and rows of a shard of kept terms.
CHUNK_BYTES = 4 << 20
MERGE_ROWS = 500_000
SHARD_ROWS = 200_000
#: DuckDB in a task.
DUCK_MEMORY = "256MB"
KEYS = ["lang", "term", "source"]
COLUMNS = [*KEYS, "n", "d"]

#: p of a count n in a group of all counts N with V kept terms.
_P = "CAST(1 + ({scale}::HUGEINT * ({n} + {s})) // ({all} + {s} * {v}) AS BIGINT)"


def _p(n: str, all_: str, v: str = "v") -> str:
    return _P.format(scale=SCALE, s=SMOOTHING, n=n, all=all_, v=v)


#: groups: lang, source, n_all (of the source), lang_all, v. rows: lang, term, source, n, lang_n.
PARTIAL_PAIRS = f"""
WITH own AS (SELECT lang, source, n_all, v, {_p("0", "n_all")} AS p0 FROM groups WHERE v > 0),
here AS (SELECT lang, count(DISTINCT term) AS t FROM kept GROUP BY lang),
held AS (SELECT k.lang, k.term, k.source, o.p0, {_p("k.n", "o.n_all", "o.v")} AS p FROM kept k JOIN own o USING (lang, source)),
counts AS (SELECT lang, source, p0, p, count(*) AS m FROM held GROUP BY ALL),
absent AS (SELECT a.lang, a.source AS a, b.source AS b, here.t * abs(a.p0 - b.p0) AS f FROM own a JOIN own b ON a.lang = b.lang AND a.source < b.source JOIN here ON here.lang = a.lang),
one AS (SELECT c.lang, least(c.source, b.source) AS a, greatest(c.source, b.source) AS b, sum(m * (abs(c.p - b.p0) - abs(c.p0 - b.p0))) AS f FROM counts c JOIN own b ON b.lang = c.lang AND b.source <> c.source GROUP BY ALL),
two AS (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p) - abs(x.p - y.p0) - abs(x.p0 - y.p) + abs(x.p0 - y.p0)) AS f FROM held x JOIN held y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source GROUP BY ALL)
SELECT lang, a AS source, b AS item, CAST(sum(f) AS BIGINT) AS value FROM (FROM absent UNION ALL FROM one UNION ALL FROM two) GROUP BY ALL"""

PARTIAL_TERMS = f"""
WITH each AS (SELECT k.lang, k.source, k.term AS item, {_p("k.n", "g.n_all", "g.v")} - {_p("k.lang_n", "g.lang_all", "g.v")} AS value FROM kept k JOIN groups g USING (lang, source))
SELECT lang, source, item, value FROM each WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP}"""


class _Duck:
    """A DuckDB of one task; what it spills goes with it."""

    def __enter__(self):
        import duckdb

        self.folder = tempfile.mkdtemp()
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": self.folder, "preserve_insertion_order": False})
        return self.con

    def __exit__(self, *_):
        self.con.close()
        shutil.rmtree(self.folder, ignore_errors=True)


SUMS = [("n", "sum"), ("d", "sum")]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term in each group, and documents that hold it, summed over about MERGE_ROWS rows of chunks."""
    held: list[pa.RecordBatch] = []

    def merged() -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        if len(held) > 1:
            whole = whole.group_by(KEYS, use_threads=False).aggregate(SUMS).select([*KEYS, "n_sum", "d_sum"]).rename_columns(COLUMNS)
        held.clear()
        yield from whole.to_batches(50_000)

    for batch in batches:
        for piece in textkit.chunks(batch, size=CHUNK_BYTES):
            held.append(_counts(piece))
            if sum(x.num_rows for x in held) >= MERGE_ROWS:
                yield from merged()
    if held:
        yield from merged()


def _counts(piece: pa.RecordBatch) -> pa.RecordBatch:
    names, code, doc, tf = words.terms(piece.column("text"), words.LETTERS).counted()
    seen: dict = {}
    group = np.array([seen.setdefault(x, len(seen)) for x in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), strict=True)], np.int64)
    groups = list(seen)
    key, at = np.unique(code * len(groups) + group[doc], return_inverse=True)
    n, d = np.bincount(at, tf, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
    own = pa.array(key % len(groups))
    return pa.record_batch([pa.array([g[0] for g in groups], pa.string()).take(own), names.cast(pa.string()).take(pa.array(key // len(groups))), pa.array([g[1] for g in groups], pa.string()).take(own), pa.array(n), pa.array(d)], names=COLUMNS)


def _keep(least: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs over one partition, which holds all rows of its (lang, term)s."""
        first = next(batches, None)
        if first is None:
            return
        with _Duck() as con:
            con.register("incoming", pa.RecordBatchReader.from_batches(first.schema, chain([first], batches)))
            con.execute("CREATE TABLE counted AS SELECT lang, term, source, CAST(sum(n) AS BIGINT) AS n, sum(d) AS d FROM incoming GROUP BY ALL")
            con.execute("CREATE TABLE often AS SELECT lang, term FROM counted GROUP BY ALL HAVING sum(d) >= ?", [least])
            yield from con.sql("SELECT lang, term, source, n FROM counted SEMI JOIN often USING (lang, term)").to_arrow_reader(20_000)

    return keep


def _partial(sql: str):
    def partial(groups: pa.Table, kept: pa.Table) -> pa.Table:
        with _Duck() as con:
            con.register("groups", groups)
            con.register("kept", kept)
            return con.sql(sql).to_arrow_table()

    return partial


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank). Of each source (a group: language and source), part `pair` holds every other
    source of the language as item and the summed difference of all kept terms as value; part `term` holds the TOP kept terms
    that it uses more than its language does.

    A group, or a language, that has a term n times of N occurrences of all V kept terms gives it
    p = 1 + (SCALE * (n + SMOOTHING)) div (N + SMOOTHING * V); a difference is that of two p."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    groups = rows.select("lang", "source").distinct()
    counted = rows.mapInArrow(_count, "lang string, term string, source string, n long, d long")
    kept = written(counted.repartition("lang", "term").mapInArrow(_keep(least_docs), "lang string, term string, source string, n long"), "kept-terms")
    by_term = written(kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "term-counts")
    by_lang = by_term.groupBy("lang").agg(F.sum("lang_n").alias("lang_all"), F.count("*").alias("v"))
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    facts = written(groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", zero("n_all"), zero("lang_all"), zero("v")), "groups")
    shards = -(-kept.count() // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(max(1, shards))).alias("shard")
    left = facts.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, shards) - 1).cast("long")))).groupBy("shard")
    right = kept.join(by_term, ["lang", "term"]).withColumn("shard", shard).groupBy("shard")
    columns = "lang string, source string, item string, value long"
    half = left.cogroup(right).applyInArrow(_partial(PARTIAL_PAIRS), columns)
    half = written(half.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    other = facts.select("lang", F.col("source").alias("item"))
    pairs = facts.select("lang", "source").join(other, "lang").where("source <> item")
    pairs = pairs.join(half.union(half.select("lang", F.col("item"), F.col("source"), "value")), ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    terms = left.cogroup(right).applyInArrow(_partial(PARTIAL_TERMS), columns)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = terms.withColumn("rank", place).where(F.col("rank") <= TOP)
    of = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return of(pairs.withColumn("rank", place), "pair").union(of(first, "term"))
