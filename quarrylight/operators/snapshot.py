"""The document-local snapshot: for every request, which revision of a document may be served, why others may not, and the
passages of it that a query matches, as one JSON text.

A request names one or two anchors (document, hash, file). An anchor's family are the registered documents of equal family,
language and maker. The family is authoritative if it is short enough, agrees on kind and product, has one active revision and
one root, links back and forth, and if a walk from the root along the links reaches all of it; the first rule that fails is
the reason of the rejection. The walk is a recursive query that carries its path, so circles and forks end.

All requests go through together. A family is cut to the limit and one more before it meets its anchors, so a family of very
many documents costs no more than a long one; the walk runs over families within the limit alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.session import written

#: Bounds of a request and states of a revision. Fixed values.
MOST_ANCHORS, MOST_FILE = 2, 512
ACTIVE, PAST = "active", "superseded"
FAMILY = ("document_family", "language", "manufacturer")
IDENTITY = ("document_family", "language", "doc_type", "manufacturer", "product_model")
SCOPE = ("request_id", "scope_rank")


def _blank(c: str) -> Column:
    return F.btrim(F.coalesce(F.col(c), F.lit(""))) == ""


def anchored(anchors: DataFrame, registry: DataFrame) -> DataFrame:
    """anchors (request_id, scope_rank, document_id, extraction_sha256, source_file) with the registered document they name."""
    valid = F.col("document_id").isNotNull() & F.col("extraction_sha256").rlike("^[0-9a-f]{64}$") & F.length(F.btrim(F.col("source_file"))).between(1, MOST_FILE)
    asked = anchors.select(*SCOPE, "document_id", F.col("extraction_sha256").alias("anchor_sha"), F.col("source_file").alias("anchor_file"), F.coalesce(valid, F.lit(False)).alias("anchor_valid"))
    full = ~(_blank("document_family") | _blank("language") | _blank("doc_type") | _blank("manufacturer") | _blank("product_model"))
    seeds = registry.withColumnRenamed("id", "seed_id")
    joined = asked.join(seeds, F.col("anchor_valid") & (F.col("document_id") == F.col("seed_id")), "left").drop("document_id")
    return joined.withColumn("identity_complete", F.col("seed_id").isNotNull() & full)


def family_rows(seeds: DataFrame, registry: DataFrame, language: str, limit: int) -> DataFrame:
    """(request_id, scope_rank, document): the first limit + 1 documents of each anchor's family, by id."""
    least = F.row_number().over(Window.partitionBy(*FAMILY).orderBy("id"))
    cut = registry.where(F.lower("language") == language).withColumn("place", least).where(F.col("place") <= limit + 1).drop("place")
    keys = seeds.where(F.col("identity_complete") & (F.lower("language") == language)).select(*SCOPE, *FAMILY)
    return keys.join(cut, list(FAMILY)).select(*SCOPE, *registry.columns)  # complete identities have no null keys


def walked(family: DataFrame, limit: int) -> DataFrame:
    """(request_id, scope_rank, walked_count): documents that a walk from the roots reaches, along supersedes_id."""
    spark, name = family.sparkSession, f"family_{uuid.uuid4().hex}"
    family.createOrReplaceTempView(name)
    setting = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "-1")  # the rows are bounded by the families, which are bounded each
    try:
        walk = spark.sql(
            f"""WITH RECURSIVE walk AS (
                SELECT request_id, scope_rank, id, array(id) AS path FROM {name} WHERE supersedes_id IS NULL
                UNION ALL
                SELECT n.request_id, n.scope_rank, n.id, array_append(w.path, n.id) FROM walk w
                JOIN {name} n ON n.request_id = w.request_id AND n.scope_rank = w.scope_rank AND n.supersedes_id = w.id
                WHERE NOT array_contains(w.path, n.id) AND size(w.path) <= {int(limit)})
            SELECT request_id, scope_rank, count(DISTINCT id) AS walked_count FROM walk GROUP BY ALL"""
        )
        return written(walk, "walk")
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
        spark.catalog.dropTempView(name)


def authority(seeds: DataFrame, family: DataFrame, language: str, limit: int) -> DataFrame:
    """seeds with family_count and authority_status: `ok`, or the first rule that the anchor or its family breaks."""
    own = seeds.select(*SCOPE, F.col("doc_type").alias("seed_type"), F.col("product_model").alias("seed_model"))
    drift = ~F.col("doc_type").eqNullSafe(F.col("seed_type")) | ~F.col("product_model").eqNullSafe(F.col("seed_model"))
    facts = family.join(own, list(SCOPE)).groupBy(*SCOPE).agg(
        F.count("id").alias("family_count"),
        F.count_if(F.col("status") == ACTIVE).alias("active_count"),
        F.count_if(F.col("supersedes_id").isNull()).alias("root_count"),
        F.count_if(~F.col("status").isin(ACTIVE, PAST)).alias("invalid_count"),
        F.count_if(drift).alias("drift_count"),
    )
    links = family.select(*SCOPE, "id", "supersedes_id", "superseded_by_id")
    older = links.select(*SCOPE, F.col("id").alias("supersedes_id"), F.col("superseded_by_id").alias("older_next"))
    newer = links.select(*SCOPE, F.col("id").alias("superseded_by_id"), F.col("supersedes_id").alias("newer_last"))
    both = links.join(older, [*SCOPE, "supersedes_id"], "left").join(newer, [*SCOPE, "superseded_by_id"], "left")
    back = F.col("supersedes_id").isNull() | F.coalesce(F.col("older_next") == F.col("id"), F.lit(False))
    forth = F.col("superseded_by_id").isNull() | F.coalesce(F.col("newer_last") == F.col("id"), F.lit(False))
    reciprocal = both.groupBy(*SCOPE).agg(F.bool_and(back & forth).alias("reciprocal"))
    short = facts.where(F.col("family_count") <= limit).select(*SCOPE)
    walk = walked(family.join(short, list(SCOPE), "left_semi").select(*SCOPE, "id", "supersedes_id"), limit)
    all_ = seeds.join(facts, list(SCOPE), "left").join(reciprocal, list(SCOPE), "left").join(walk, list(SCOPE), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    unbound = (F.col("status") != ACTIVE) | F.col("status").isNull() | F.col("superseded_by_id").isNotNull() | ~F.lower("source_pdf_sha256").eqNullSafe(F.col("anchor_sha")) | ~F.col("source_pdf_filename").eqNullSafe(F.col("anchor_file"))
    status = (
        F.when(~F.col("anchor_valid"), "invalid_anchor_scope")
        .when(F.col("seed_id").isNull(), "document_seed_not_found")
        .when(~F.col("identity_complete"), "ambiguous_document_family")
        .when(F.lower("language") != language, "unsupported_document_language")
        .when(unbound, "active_revision_not_bound_to_anchor_blob")
        .when(n("family_count") > limit, "document_scope_overflow")
        .when(n("drift_count") != 0, "ambiguous_document_family")
        .when(n("invalid_count") != 0, "invalid_revision_status")
        .when(n("active_count") != 1, "ambiguous_active_revision")
        .when(n("root_count") != 1, "branched_or_cyclic_revision_chain")
        .when(~F.coalesce(F.col("reciprocal"), F.lit(False)), "nonreciprocal_revision_chain")
        .when(n("walked_count") != n("family_count"), "incomplete_revision_chain")
        .otherwise("ok")
    )
    return all_.select(*seeds.columns, n("family_count").alias("family_count"), status.alias("authority_status"))


def matches(content: Column, any_of: list[list[str]]) -> Column:
    """Whether a text has all the words of one of the alternatives (folded words)."""
    words = T.tokens(content)
    return F.exists(F.array(*[F.lit(len(F_) > 0) & T.let(words, lambda w, F_=F_: F.forall(F.array(*map(F.lit, F_)), lambda t: F.array_contains(w, t))) for F_ in any_of]), lambda x: x)


def snapshot(anchors: DataFrame, registry: DataFrame, chunks: DataFrame, any_of: list[list[str]], language: str = "es", family_limit: int = 16, candidate_limit: int = 64, payload: tuple[str, ...] = ("content",)) -> DataFrame:
    """(request_id, input_status, snapshot): one row for each request that has an anchor.

    registry: id, document_family, revision, language, doc_type, manufacturer, product_model, source_pdf_filename,
    source_pdf_sha256, status, supersedes_id, superseded_by_id. chunks: id, document_id, extraction_sha256, source_file,
    chunk_index, duplicate_of, and the columns of `payload`. A request of more than MOST_ANCHORS anchors is invalid and has
    empty lists. A document that both anchors name is served once. Null request ids are left out."""
    asked = anchors.where("request_id is not null")
    size = asked.groupBy("request_id").agg(F.count("*").alias("n_anchors"))
    sound = size.where(F.col("n_anchors") <= MOST_ANCHORS).select("request_id")
    seeds = written(anchored(asked.join(sound, "request_id", "left_semi"), registry), "seeds")
    family = written(family_rows(seeds, registry, language, family_limit), "family")
    checks = written(authority(seeds, family, language, family_limit), "checks")
    first = F.row_number().over(Window.partitionBy("request_id", "seed_id").orderBy("scope_rank"))
    served = checks.where("authority_status = 'ok'").withColumn("place", first).where("place = 1").drop("place")
    own = served.select("request_id", "scope_rank", F.col("seed_id").alias("document_id"), F.lower("source_pdf_sha256").alias("extraction_sha256"), F.col("source_pdf_filename").alias("source_file"), "revision")
    live = chunks.where(F.col("duplicate_of").isNull()).withColumn("extraction_sha256", F.lower("extraction_sha256"))
    found = live.join(own, ["document_id", "extraction_sha256", "source_file"]).where(matches(F.col("content"), any_of))
    place = F.row_number().over(Window.partitionBy("request_id", "document_id").orderBy(F.asc_nulls_last("chunk_index"), "id"))
    candidates = written(found.withColumn("place", place).where(F.col("place") <= candidate_limit + 1).select("request_id", "scope_rank", "document_id", "place", "id", "chunk_index", "revision", *payload), "candidates")

    def listed(rows: DataFrame, name: str, order: list[str], fields: list) -> DataFrame:
        """One sorted list for each request; a request has two families and two sets of candidates at most."""
        return rows.select("request_id", F.struct(F.struct(*order).alias("by"), F.struct(*fields).alias("row")).alias("r")).groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]).alias(name))

    over = candidates.where(F.col("place") == candidate_limit + 1).select("request_id", "scope_rank").distinct()
    lists = [
        listed(served.withColumnRenamed("seed_id", "document_id"), "authorities", ["document_id"], ["scope_rank", "document_id", F.lower("source_pdf_sha256").alias("extraction_sha256"), F.col("source_pdf_filename").alias("source_file"), "language", "revision", F.col("family_count").alias("family_rows")]),
        listed(family, "document_rows", ["scope_rank", "id"], ["scope_rank", *[c for c in family.columns if c not in SCOPE]]),
        listed(candidates, "candidates", ["document_id", "place", "id"], ["document_id", "id", "chunk_index", *payload, "revision", "scope_rank", "place"]),
        listed(checks.where("authority_status <> 'ok'"), "rejections", ["scope_rank"], ["scope_rank", F.col("authority_status").alias("reason")]),
        over.groupBy("request_id").agg(F.sort_array(F.collect_list("scope_rank")).alias("candidate_overflow_scopes")),
    ]
    out = size.select("request_id", F.when(F.col("n_anchors") <= MOST_ANCHORS, "ok").otherwise("invalid_request").alias("input_status"))
    for df in lists:
        name = df.columns[-1]
        out = out.join(df, "request_id", "left").withColumn(name, F.coalesce(name, F.array().cast(df.schema[name].dataType)))
    parts = [F.lit("document_local_snapshot_v1").alias("schema"), "input_status", "authorities", "document_rows", "candidates", "rejections", F.size("document_rows").alias("family_rows_read"), F.size("candidates").alias("candidate_rows"), "candidate_overflow_scopes"]
    return out.select("request_id", "input_status", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("snapshot"))
