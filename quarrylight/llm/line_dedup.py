"""Removal of boilerplate lines: lines that stand on many sites.

For each distinct line a HyperLogLog sketch of its sites is built by aggregation (partial sketches merge on the way, so a line
that a third of all rows have costs a small sketch for each task). The estimate decides lines far from the threshold; lines
whose estimate is near it get an exact count of distinct sites. Everything runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import broadcast_if_small, fresh, written

#: A line on so many distinct sites or more is boilerplate.
SITES = 10
#: Near the threshold: an estimate between these multiples of it. Sketches of 2^LOG_K registers err by about 2 % there.
LOG_K = 11
NEAR = (0.75, 1.5)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> list[Column]:
    """Two hashes, 96 bits, of the line without the white space around it."""
    trimmed = F.btrim(line, F.lit(" \t\r"))
    return [F.xxhash64(trimmed).alias("h1"), F.hash(trimmed).alias("h2")]


def boilerplate(docs: DataFrame, sites: int = SITES, text: str = "text", site: str = "source") -> DataFrame:
    """(h1, h2, sites): keys of the lines on `sites` distinct sites or more. Blank lines and null sites don't count."""
    lines = docs.select(F.col(site).cast("string").alias("site"), F.explode(lines_of(F.col(text))).alias("line")).where(F.col("site").isNotNull() & (F.btrim("line", F.lit(" \t\r")) != ""))
    keyed = lines.select(*_key(F.col("line")), "site")
    estimated = keyed.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("estimate"))
    seen = written(estimated.where(F.col("estimate") >= NEAR[0] * sites), "sketches")
    sure = seen.where(F.col("estimate") > NEAR[1] * sites).select("h1", "h2", F.col("estimate").alias("sites"))
    near = broadcast_if_small(seen.where(F.col("estimate") <= NEAR[1] * sites).select("h1", "h2"))
    exact = keyed.join(near, ["h1", "h2"]).distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= sites)
    return sure.union(exact)


def remove_boilerplate(docs: DataFrame, sites: int = SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """docs with their columns; text loses its boilerplate lines, `n_lines` and `n_removed` (long) are added.

    Null text stays null, with no lines; an empty text has one blank line. Blank lines and the order of lines stay; every
    copy of a boilerplate line goes, also the first. Documents with null sites are cleaned too, but don't count as sites. Rows
    that repeat a doc_id are cleaned each on its own. Very long texts are cleaned whole; no rows: no rows. Columns of docs named n_lines or n_removed are replaced.
    """
    found = written(boilerplate(docs, sites, text, site).select("h1", "h2"), "boilerplate")
    rows = docs.select(F.xxhash64(F.col(text).cast("string")).alias("t"), F.col(text).cast("string").alias("text"))
    hit = rows.select("t", F.explode(F.transform(lines_of(F.col("text")), lambda x: F.struct(*_key(x)))).alias("k")).select("t", "k.h1", "k.h2")
    lost = written(hit.join(broadcast_if_small(found), ["h1", "h2"]).distinct().groupBy("t").agg(F.collect_list(F.struct("h1", "h2")).alias("cut")), "cut")
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    t, cut = fresh("text_hash", docs), fresh("cut_lines", docs)
    joined = docs.select(*kept, F.xxhash64(F.col(text).cast("string")).alias(t)).join(broadcast_if_small(lost.toDF(t, cut)), t, "left")
    body = F.col(text).cast("string")
    every = lines_of(body)
    stay = F.filter(every, lambda x: ~F.array_contains(cut, F.struct(*_key(x))))
    gone = F.when(F.col(cut).isNull(), F.lit(0)).otherwise(F.size(every) - F.size(stay)).cast("long")
    new = F.when(F.col(cut).isNull(), body).otherwise(F.array_join(stay, "\n"))
    return joined.select(*[new.alias(c) if c == text else F.col(c) for c in kept], F.when(body.isNull(), F.lit(0)).otherwise(F.size(every)).cast("long").alias("n_lines"), gone.alias("n_removed"))
