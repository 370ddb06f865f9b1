"""The registered queries: each applies an operator to whole driver tables; SQL says the same in DuckDB.

Roles: events are logged turns; documents (source as file or maker) and pages the corpus; benchmark items queries; embeddings
with label as product group; labels judgements; conversations ordered turns; orders, lineitem, part and customer the records
of documents' lives. Search queries among vectors are the rows whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import corpus, evaluate, fusion, identity, lexical, vector
from quarrylight.plans import analytics as A
from quarrylight.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from quarrylight.session import table
from quarrylight.streaming import events as S

# SQL fragments that queries share
DAY = "strftime(ts, '%Y-%m-%d')"
WEEK = "strftime(date_trunc('week', ts), '%Y-%m-%d')"
K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
CHANNEL = f"CASE WHEN {K} IS NULL THEN 'unknown' WHEN {K} % 4 = 0 THEN 'web' WHEN {K} % 4 = 1 THEN 'bot' WHEN {K} % 4 = 2 THEN 'mail' ELSE 'other' END"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def sql_fold(c: str) -> str:
    return f"translate(lower(coalesce({c}, '')), '{T.ACCENTED}', '{T.PLAIN}')"


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all({sql_fold(c)}, '[a-z0-9]{{3,}}'), lambda x: NOT list_contains({STOP}, x))"


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


def sql_health(period: str) -> str:
    return f"""SELECT {period} AS period, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_errors, count(DISTINCT user_id) FILTER (WHERE event_type <> 'error') AS people,
    round(quantile_cont(value, 0.5) FILTER (WHERE event_type <> 'error'), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (WHERE event_type <> 'error'), 6) AS p95,
    round(count(*) FILTER (WHERE event_type = 'error') * 100.0::DOUBLE / count(*), 1) AS error_share FROM events GROUP BY 1"""


@query(sql_health(DAY))
def health_daily(spark, d):
    return A.health(table(spark, d, "events"), A.day())


@query(sql_health(WEEK))
def health_weekly(spark, d):
    return A.health(table(spark, d, "events"), A.week())


@query(f"SELECT {WEEK} AS week, {CHANNEL} AS channel, count(*) AS n, count(DISTINCT user_id) AS people FROM events GROUP BY 1, 2")
def usage_by_channel(spark, d):
    return A.usage_by_channel(table(spark, d, "events"))


@query(
    f"""WITH v AS (SELECT {WEEK} AS week, count(*) FILTER (WHERE event_type = 'purchase') AS positive, count(*) FILTER (WHERE event_type = 'error') AS negative FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1),
    p AS (SELECT {WEEK} AS week, count(*) AS prose FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT week, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(prose, 0) AS prose, round(positive * 100.0::DOUBLE / nullif(positive + negative, 0), 1) AS approval FROM v FULL JOIN p USING (week)"""
)
def feedback_weekly(spark, d):
    return A.feedback(table(spark, d, "events"))


@query(f"SELECT {WEEK} AS week, CASE WHEN {K} < 30 THEN 'wrong' WHEN {K} < 60 THEN 'incomplete' WHEN {K} < 90 THEN 'off_topic' ELSE 'unstated' END AS reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def negative_reasons(spark, d):
    return A.negative_reasons(table(spark, d, "events"))


@query(
    f"""WITH g AS (SELECT {DAY} AS day, count(*) AS n, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL AND strlen(props) <= 8192) AS n_traced, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL AND strlen(props) <= 8192 AND {K} % 4 = 0) AS n_first FROM events GROUP BY 1)
    SELECT *, round(n_first * 100.0::DOUBLE / nullif(n_traced, 0), 1) AS first_share FROM g"""
)
def channel_health_json(spark, d):
    return A.channel_health(table(spark, d, "events"))


@query(
    f"""WITH t AS (SELECT event_type, value AS total, CAST({K} AS DOUBLE) AS first FROM events), u AS (SELECT *, total - first AS rest FROM t WHERE total IS NOT NULL AND first IS NOT NULL AND total >= 0 AND first BETWEEN 0 AND 100)
    SELECT event_type, count(*) AS n, """
    + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_p{int(q * 100)}" for c in ("total", "first", "rest") for q in (0.5, 0.95))
    + " FROM u GROUP BY 1"
)
def stage_latency_guarded(spark, d):
    return A.stage_latency(table(spark, d, "events"))


@query(
    f"""WITH m AS (SELECT {WEEK} AS week, user_id, unnest(list_distinct(list_filter([event_type, {CHANNEL}, CASE WHEN {K} >= 50 THEN 'high' END], lambda x: x IS NOT NULL))) AS mention FROM events)
    SELECT week, mention, count(*) AS n, count(DISTINCT user_id) AS people FROM m GROUP BY 1, 2"""
)
def array_unnest_weekly(spark, d):
    return A.exploded_mentions(table(spark, d, "events"))


@query(
    f"""WITH m AS (SELECT conv_id, turn, unnest({sql_tokens('text')}) AS mention FROM conversations WHERE role = 'user'), known AS (SELECT DISTINCT unnest({sql_tokens('text')}) AS mention FROM documents)
    SELECT mention, count(*) AS n, count(DISTINCT conv_id) AS n_conversations FROM m ANTI JOIN known USING (mention) GROUP BY 1"""
)
def uncovered_mentions(spark, d):
    said = table(spark, d, "conversations").where("role = 'user'").select("conv_id", F.explode(T.tokens(F.col("text"))).alias("mention"))
    known = table(spark, d, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("mention")).distinct()
    return said.join(known, "mention", "left_anti").groupBy("mention").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_conversations"))


@query("SELECT d.source, count(*) AS n, count(l.doc_id) AS classified, count(*) FILTER (WHERE l.doc_id IS NULL) AS pending, min(quality) AS least, max(quality) AS most FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def classification_coverage(spark, d):
    return A.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "source")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def classification_pending(spark, d):
    return A.pending(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query(
    """WITH o AS (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1), e AS (SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1)
    SELECT c_custkey, coalesce(orders, 0) AS orders, round(coalesce(spent, 0), 2) AS spent, coalesce(events, 0) AS events, coalesce(errors, 0) AS errors FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN e ON c_custkey = user_id"""
)
def person_activity(spark, d):
    return A.person_activity(table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "events"))


@query("SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type = 'purchase' AND value >= 10 ORDER BY ts DESC, event_id LIMIT 500")
def explorer_filtered(spark, d):
    return A.explorer(table(spark, d, "events"), "2024-01-15 00:00:00", "purchase", 10.0).select("event_id", "user_id", "value")


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN user_id END AS user_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN sha256('pepper' || user_id) END AS pseudonym FROM events")
def retention_pass(spark, d):
    return A.retention(table(spark, d, "events"), "2024-01-15 00:00:00")


@query(f"SELECT {DAY} AS day, count(*) AS n, count(DISTINCT user_id) AS people FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1")
def retention_receipt(spark, d):
    return A.retention_receipt(table(spark, d, "events"), "2024-01-15 00:00:00")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def still_identified(spark, d):
    return A.still_identified(table(spark, d, "customer"), table(spark, d, "events").select("user_id"), table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey")).select("c_custkey")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, round(CASE WHEN count(*) FILTER (WHERE event_type = 'error') <= 0 THEN 0 ELSE least(900.0, 2.0 * pow(2.0, count(*) FILTER (WHERE event_type = 'error') - 1)) END, 3) AS wait FROM events GROUP BY 1")
def throttle_waits(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    return g.withColumn("wait", F.round(A.throttle_wait(F.col("failures")), 3))


# conversations and joins


@query(
    f"""WITH l AS (SELECT doc_id, source, text, n_chars FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id AS note_id, source, left(text, 200) AS head FROM documents WHERE length(text) >= 40 AND doc_id % 2 = 0)
    SELECT note_id, arg_max(doc_id, struct_pack(a := n_chars, i := doc_id)) AS doc_id FROM n JOIN l USING (source) WHERE starts_with(l.text, n.head) GROUP BY 1"""
)
def log_feedback_prefix(spark, d):
    """Which log row of the same source a note of 200 signs was about; the longest row wins."""
    docs = table(spark, d, "documents").where("text is not null")
    notes = docs.where("length(text) >= 40 and doc_id % 2 = 0").select("source", F.left("text", F.lit(200)).alias("note"), F.col("doc_id").alias("note_id"))
    return identity.matched_by_prefix(notes, docs, "source", "note", "text", "n_chars", "doc_id", "note_id", 200)


@query("WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts AS pts, event_id AS pid FROM events WHERE event_type = 'purchase') SELECT e.event_id, p.pid AS value FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.pts")
def latest_before(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return identity.latest_before(left, e.where("event_type = 'purchase'"), "user_id", "ts", "ts", F.col("event_id")).select("event_id", "value")


@query("SELECT DISTINCT a.l_orderkey, a.l_linenumber, b.l_linenumber AS near, abs(a.l_linenumber - b.l_linenumber) AS distance FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) BETWEEN 1 AND 2")
def neighbor_window(spark, d):
    return identity.neighbours(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber", 2)


# vectors


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


TOPK = """SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0"""


@query(f"WITH s AS ({TOPK} AND v.vec_id <> q.vec_id OR q.vec_id % 100 = 0 AND v.vec_id = q.vec_id) SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM s WHERE s > 0.2) WHERE rank <= 10")
def vec_topk(spark, d):
    rows, queries = _vectors(spark, d)
    return vector.top_k(rows, queries, 10, 0.2).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH s AS ({TOPK} AND v.label = q.label) SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM s WHERE s > 0.1) WHERE rank <= 5")
def vec_topk_filtered(spark, d):
    rows, queries = _vectors(spark, d)
    return vector.top_k(rows, queries, 5, 0.1, same="label").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH s AS ({TOPK}), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM s WHERE s > 0.0) SELECT query_id, vec_id // 10 AS parent_id, max(round(s, 6)) AS similarity, arg_max(vec_id, struct_pack(s := round(s, 6), r := -vec_id)) AS via, count(*) AS n_hits FROM t WHERE rank <= 50 GROUP BY 1, 2")
def vec_parent_keepmax(spark, d):
    rows, queries = _vectors(spark, d)
    return vector.keep_max_by_parent(vector.top_k(rows, queries, 50, 0.0), F.floor(F.col("vec_id") / 10))


@query("SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.35")
def vec_semantic_pairs(spark, d):
    return vector.pairs_in_groups(table(spark, d, "embeddings"), "label", 0.35)


@query()
def vec_greedy_dedup(spark, d):
    return vector.greedy_dedup(table(spark, d, "embeddings"), "label", 0.94)


# lexical search


def sql_bm25(doc_tokens: str, query_tokens: str, distinct: bool = True, k: int = 10) -> str:
    q = f"list_distinct({query_tokens})" if distinct else query_tokens
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {doc_tokens} AS toks FROM documents), facts AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM d),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({q}) AS term FROM benchmark) GROUP BY 1, 2),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS n, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avg_len)) * times), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), facts GROUP BY 1, 2)
    SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"""


def _bm25(spark, d, **how):
    return lexical.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), how.pop("doc_tokens", T.tokens(F.col("text"))), T.tokens(F.col("text")), **how)


@query(sql_bm25(sql_tokens("text"), sql_tokens("text")))
def bm25_rank(spark, d):
    return _bm25(spark, d)


@query(sql_bm25(sql_tokens("text"), sql_tokens("text"), distinct=False))
def bm25_repeated_terms(spark, d):
    return _bm25(spark, d, distinct_terms=False)


HEAD = "split_part(coalesce(text, ''), chr(10), 1)"
BODY = "CASE WHEN instr(coalesce(text, ''), chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END"


@query(sql_bm25(f"list_concat({sql_tokens(BODY)}, {sql_tokens(HEAD)}, {sql_tokens(HEAD)}, {sql_tokens(HEAD)})", sql_tokens("text")))
def bm25_field_weighted(spark, d):
    return _bm25(spark, d, doc_tokens=T.tokens(T.body(F.col("text"))), title_tokens=T.tokens(T.heading(F.col("text"))))


@query(
    f"""WITH q AS (SELECT item_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM benchmark), f AS (SELECT doc_id, unnest({sql_tokens(HEAD)}) AS term, 1.0 AS w FROM documents UNION ALL SELECT doc_id, unnest({sql_tokens(BODY)}), 0.4 FROM documents UNION ALL SELECT doc_id, unnest({sql_tokens('source')}), 0.2 FROM documents),
    b AS (SELECT doc_id, term, max(w) AS w FROM f WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), s AS (SELECT item_id, doc_id, count(*) AS n_terms, round(sum(w), 6)::DOUBLE AS score FROM b JOIN q USING (term) GROUP BY 1, 2)
    SELECT item_id, doc_id, n_terms, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""
)
def fts_match_rank(spark, d):
    t = F.col("text")
    fields = {"title": (T.tokens(T.heading(t)), 1.0), "content": (T.tokens(T.body(t)), 0.4), "source": (T.tokens(F.col("source")), 0.2)}
    return lexical.weighted_match(table(spark, d, "documents"), table(spark, d, "benchmark"), fields, T.tokens(t))


@query(
    f"""WITH q AS (SELECT item_id, list_distinct({sql_tokens('text')}) AS items FROM benchmark), d AS (SELECT doc_id, list_distinct({sql_tokens('text')}) AS items FROM documents),
    b AS (SELECT item_id, doc_id, nq, nd, count(*) AS n_common FROM (SELECT item_id, len(items) AS nq, unnest(items) AS item FROM q) JOIN (SELECT doc_id, len(items) AS nd, unnest(items) AS item FROM d) USING (item) GROUP BY 1, 2, 3, 4)
    SELECT item_id, doc_id, n_common, round(n_common / (nq + nd - n_common), 6) AS jaccard, round(n_common / nq, 6) AS containment FROM b WHERE round(n_common / nq, 6) >= 0.5"""
)
def token_jaccard(spark, d):
    t = T.tokens(F.col("text"))
    return lexical.overlap(table(spark, d, "documents"), table(spark, d, "benchmark"), t, t).where("containment >= 0.5")


def sql_shingles(c: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({c}) - 4, 1) + 1), lambda i: array_to_string({c}[i:i+4], ' ')))"


@query(
    f"""WITH q0 AS (SELECT item_id, {sql_words('text')} AS w FROM benchmark), d0 AS (SELECT doc_id, {sql_words('text')} AS w FROM documents), q AS (SELECT item_id, {sql_shingles('w')} AS items FROM q0), d AS (SELECT doc_id, {sql_shingles('w')} AS items FROM d0),
    b AS (SELECT item_id, doc_id, nq, nd, count(*) AS n_common FROM (SELECT item_id, len(items) AS nq, unnest(items) AS item FROM q) JOIN (SELECT doc_id, len(items) AS nd, unnest(items) AS item FROM d) USING (item) GROUP BY 1, 2, 3, 4)
    SELECT item_id, doc_id, n_common, round(n_common / (nq + nd - n_common), 6) AS jaccard, round(n_common / nq, 6) AS containment FROM b"""
)
def shingle_containment(spark, d):
    s = T.shingle_hashes(T.words(F.col("text")), 5)
    return lexical.overlap(table(spark, d, "documents"), table(spark, d, "benchmark"), s, s)


STEMS = ["ther", "ing", "tion", "ent", "auto", "able", "ess"]


@query(
    f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents) SELECT * FROM (SELECT doc_id, len(list_filter({STEMS}, lambda s: len(list_filter(toks, lambda t: starts_with(t, s))) > 0)) AS n_stems, len(list_filter(toks, lambda t: len(list_filter({STEMS}, lambda s: starts_with(t, s))) > 0)) AS n_tokens FROM t) WHERE n_stems >= 3"""
)
def facet_prefix(spark, d):
    return lexical.prefix_facets(table(spark, d, "documents"), STEMS, T.tokens(F.col("text")), 3)


# fusion: two ranked lists of vectors for each label, by their first two components


def _lists(spark, d, k: int = 20):
    v = table(spark, d, "embeddings")
    return fusion.as_list(v, "label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6), k), fusion.as_list(v, "label", "vec_id", F.round(F.col("embedding")[1].cast("double"), 6), k)


def sql_list(i: int, k: int = 20) -> str:
    return f"SELECT label AS query, vec_id AS id, s AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM (SELECT label, vec_id, round(embedding[{i}]::DOUBLE, 6) AS s FROM embeddings)) WHERE rank <= {k}"


LISTS = f"WITH a AS ({sql_list(1)}), b AS ({sql_list(2)}), s AS (SELECT *, 'lexical' AS channel, 0 AS p FROM a UNION ALL SELECT *, 'vector', 1 FROM b)"


@query(f"{LISTS}, g AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(struct_pack(p := p, r := rank)) AS seen FROM s GROUP BY 1, 2) SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen, id) AS rank FROM g")
def rrf_fuse(spark, d):
    a, b = _lists(spark, d)
    return fusion.reciprocal_rank({"lexical": a, "vector": b})


@query(f"{LISTS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, id ORDER BY p) AS n FROM s) WHERE n = 1) SELECT query, id, score, channel, row_number() OVER (PARTITION BY query ORDER BY score DESC, p, rank, id) AS place FROM k")
def merge_stamps(spark, d):
    a, b = _lists(spark, d)
    return fusion.merge_stamps({"lexical": a, "vector": b})


@query(
    f"""{LISTS}, m AS (SELECT *, max(CASE WHEN channel = 'lexical' THEN 1 ELSE 0 END) OVER (PARTITION BY query, id) AS lex, row_number() OVER (PARTITION BY query, id ORDER BY p DESC) AS n FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY lex DESC, rank, id) AS place FROM m WHERE n = 1) SELECT query, id, score, channel, place FROM o WHERE lex = 1 OR place <= 25"""
)
def merge_quota(spark, d):
    a, b = _lists(spark, d)
    return fusion.merge_quota(a, b, 25)


@query(
    f"""{LISTS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, id ORDER BY p) AS n FROM s) WHERE n = 1), r AS (SELECT label AS query, vec_id AS id, round(embedding[3]::DOUBLE, 6) AS rescored FROM embeddings WHERE vec_id % 3 > 0)
    SELECT query, id, coalesce(rescored, score) AS score, channel, row_number() OVER (PARTITION BY query ORDER BY coalesce(rescored, score) DESC, id) AS place FROM k LEFT JOIN r USING (query, id)"""
)
def merge_cosine(spark, d):
    a, b = _lists(spark, d)
    r = table(spark, d, "embeddings").where("vec_id % 3 > 0").select(F.col("label").alias("query"), F.col("vec_id").alias("id"), F.round(F.col("embedding")[2].cast("double"), 6).alias("rescored"))
    return fusion.merge_rescored({"lexical": a, "vector": b}, r)


@query(
    f"""WITH a AS ({sql_list(1)}), b AS ({sql_list(2)}), s AS (SELECT query, id, max(score) AS extra FROM b WHERE score >= 0.1 GROUP BY 1, 2), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY extra DESC, id) AS n FROM s ANTI JOIN a USING (query, id)) WHERE n <= 6),
    t AS (SELECT query, count(*) AS taken FROM n GROUP BY 1), st AS (SELECT a.* FROM a LEFT JOIN t USING (query) WHERE rank <= 15 - coalesce(taken, 0)), base AS (SELECT query, max(rank) AS base FROM st GROUP BY 1)
    SELECT query, id, greatest(score, coalesce(extra, score)) AS score, 'main' AS part, rank AS place FROM st LEFT JOIN s USING (query, id) UNION ALL SELECT query, id, extra, 'surrogate', coalesce(base, 0) + n FROM n LEFT JOIN base USING (query)"""
)
def quota_reserve(spark, d):
    a, b = _lists(spark, d)
    return fusion.reserve_quota(a, b, 15, 6, 0.1)


@query(
    f"""WITH a AS ({sql_list(1)}), b AS ({sql_list(2)}), c AS ({sql_list(3)}), x AS (SELECT * FROM (SELECT query, id, score, 1 AS part, row_number() OVER (PARTITION BY query ORDER BY rank, id) AS n FROM b ANTI JOIN a USING (query, id)) WHERE n <= 3),
    y AS (SELECT * FROM (SELECT query, id, score, 2 AS part, row_number() OVER (PARTITION BY query ORDER BY rank, id) AS n FROM (SELECT * FROM c ANTI JOIN a USING (query, id)) ANTI JOIN x USING (query, id)) WHERE n <= 2), e AS (SELECT * FROM x UNION ALL SELECT * FROM y), g AS (SELECT query, count(*) AS b FROM e GROUP BY 1),
    h AS (SELECT query, id, score, 0 AS part, rank AS n FROM a LEFT JOIN g USING (query) WHERE rank <= 15 - coalesce(b, 0)) SELECT query, id, score, part, row_number() OVER (PARTITION BY query ORDER BY part, n) AS place FROM (SELECT * FROM h UNION ALL SELECT * FROM e)"""
)
def dual_carve_out(spark, d):
    a, b = _lists(spark, d)
    c = fusion.as_list(table(spark, d, "embeddings"), "label", "vec_id", F.round(F.col("embedding")[2].cast("double"), 6), 20)
    return fusion.carve_out(a, [(b, 3), (c, 2)], 15)


@query(f"WITH a AS ({sql_list(1)}), b AS ({sql_list(2)}), f AS (SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY rank, id) AS n FROM b ANTI JOIN a USING (query, id)) WHERE n <= 4) SELECT query, id, score, rank FROM a UNION ALL SELECT query, id, score, n + (SELECT max(rank) FROM a WHERE a.query = f.query) FROM f")
def bounded_extension(spark, d):
    return fusion.extend(*_lists(spark, d), 4)


@query(
    f"""WITH a AS ({sql_list(1)}), r AS (SELECT label AS query, vec_id AS id, round(embedding[4]::DOUBLE, 6) AS rescored FROM embeddings WHERE vec_id % 2 = 0), j AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (rescored IS NULL)::INT, -rescored, rank, id) AS place FROM a LEFT JOIN r USING (query, id))
    SELECT query, id, place, CASE WHEN rescored IS NULL THEN 'padded' ELSE 'scored' END AS how FROM j WHERE place <= 8"""
)
def rerank_padded(spark, d):
    a, _ = _lists(spark, d)
    r = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("label").alias("query"), F.col("vec_id").alias("id"), F.round(F.col("embedding")[3].cast("double"), 6).alias("rescored"))
    return fusion.rerank(a, r, 8)


#: Some documents lose their language label, and one source keeps documents of other languages only.
LABELLED = "SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN lang END AS lang, CASE WHEN lower(lang) IN ('fr', 'en') AND doc_id % 5 = 0 AND doc_id % 7 > 0 THEN 'foreign' WHEN doc_id % 9 > 0 THEN source END AS source FROM documents"
SERVED = "coalesce(lower(lang) IN ('es', 'de'), trim(coalesce(lang, '')) = '')"


@query(f"WITH d AS ({LABELLED}), c AS (SELECT source, count(*) FILTER (WHERE {SERVED}) AS n FROM d GROUP BY 1) SELECT doc_id, d.source FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source WHERE {SERVED} OR n < 1")
def filter_language_failopen(spark, d):
    docs = table(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang")))
    foreign = F.lower("lang").isin("fr", "en") & (F.col("doc_id") % 5 == 0)
    docs = docs.withColumn("source", F.when(foreign, "foreign").when(F.col("doc_id") % 9 > 0, F.col("source")))
    return fusion.filter_open(docs, F.lower("lang").isin("es", "de"), "source", unlabelled=F.btrim(F.coalesce("lang", F.lit(""))) == "").select("doc_id", "source")


@query("WITH c AS (SELECT source, count(*) FILTER (WHERE contains(text, ' | ')) AS n FROM documents GROUP BY 1) SELECT doc_id, d.source FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source WHERE contains(text, ' | ') OR n < 3")
def filter_model_failopen(spark, d):
    return fusion.filter_open(table(spark, d, "documents"), F.contains("text", F.lit(" | ")), "source", 3).select("doc_id", "source")


@query(
    """WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS turn, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS p FROM documents), u AS (SELECT *, min(p) OVER (PARTITION BY lang, source) AS lead FROM t WHERE turn <= 30)
    SELECT doc_id, lang, source, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn > 2, turn, lead) AS place FROM u) WHERE place <= 30"""
)
def diversify_round_robin(spark, d):
    out = fusion.round_robin(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "lang", "source", [F.desc("n_chars"), F.col("doc_id")], 30, 2)
    return out.select("doc_id", "lang", "source", "place")


@query("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 1200")
def character_budget(spark, d):
    return fusion.budgeted(table(spark, d, "conversations"), "conv_id", [F.col("turn")], F.length("text"), 1200).select("conv_id", "turn", "used")


@query()
def complement_greedy(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("score"), T.tokens(T.heading(F.col("text"))).alias("terms"))
    return fusion.complement(docs)


# identity and lifecycle


@query(
    """WITH m AS (SELECT p_partkey, p_name, p_brand FROM part), r AS (SELECT lower(p_name) AS key, 0 AS p, 'exact' AS kind, min(p_partkey) AS target, count(DISTINCT p_partkey) AS n FROM part WHERE p_size > 40 GROUP BY 1 UNION ALL SELECT lower(p_name), 1, 'alias', min(p_size), count(DISTINCT p_size) FROM part WHERE p_size <= 2 GROUP BY 1),
    b AS (SELECT key, min(struct_pack(p := p, kind := kind, target := target, n := n)) AS b FROM r GROUP BY 1) SELECT p_partkey, CASE WHEN b.n = 1 THEN b.target END AS target, CASE WHEN b IS NULL THEN 'none' WHEN b.n = 1 THEN b.kind ELSE b.kind || '?' END AS how FROM m LEFT JOIN b ON lower(p_name) = b.key"""
)
def resolve_identity(spark, d):
    part = table(spark, d, "part")
    key = F.lower("p_name").alias("key")
    rules = [("exact", part.where("p_size > 40").select(key, F.col("p_partkey").alias("target"))), ("alias", part.where("p_size <= 2").select(key, F.col("p_size").cast("long").alias("target")))]
    return identity.resolve(part.select("p_partkey", key), rules).select("p_partkey", "target", "how")


LINKS = "SELECT o_orderkey AS source, CASE WHEN o_orderkey % 64 > 0 THEN o_orderkey - 1 ELSE o_orderkey // 3 END AS target FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey % 5 > 0 OR o_orderkey < 200 AND o_orderkey > 1"


def _links(spark, d):
    """Redirects of orders to smaller numbers; the first 200 are one long chain."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").where("o_orderkey % 3 <> 2 and o_orderkey % 5 > 0 or o_orderkey < 200 and o_orderkey > 1")
    return rows.select(k.alias("source"), F.when(k % 64 > 0, k - 1).otherwise(F.floor(k / 3)).alias("target"))


@query(
    f"""WITH RECURSIVE l AS ({LINKS}), w AS (SELECT source, target, 1 AS steps FROM l UNION ALL SELECT w.source, l.target, steps + 1 FROM w JOIN l ON w.target = l.source WHERE steps < 400)
    SELECT source, arg_max(target, steps) AS target, max(steps) AS steps FROM w GROUP BY 1"""
)
def redirect_closure(spark, d):
    return identity.follow(_links(spark, d))


@query(
    """WITH g AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN o + f + p = 0 THEN 'none' WHEN o = 1 AND f = 0 AND p = 0 THEN 'single_active' WHEN o = 0 AND f = 1 AND p = 0 THEN 'single_superseded' WHEN o = 0 AND f = 0 THEN 'only_pending' WHEN o = 1 AND f > 0 AND p = 0 THEN 'active_with_history' WHEN o = 1 AND p > 0 THEN 'active_with_pending'
    WHEN o > 1 AND f = 0 AND p = 0 THEN 'several_active' WHEN o > 1 AND f > 0 THEN 'several_active_with_history' WHEN o > 1 AND p > 0 THEN 'several_active_with_pending' WHEN o = 0 AND f > 1 AND p = 0 THEN 'only_superseded' WHEN o = 0 AND f > 0 AND p > 0 THEN 'superseded_with_pending' ELSE 'other' END AS authority FROM g"""
)
def lifecycle_authority(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("O", "n_open"), ("F", "n_finished"), ("P", "n_pending"))])
    return g.select("o_custkey", identity.authority(g).alias("authority"))


@query(
    """WITH v AS (SELECT DISTINCT 'line without order' AS invariant, CAST(l_orderkey AS VARCHAR) AS subject FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey UNION SELECT DISTINCT 'order without customer', CAST(o_custkey AS VARCHAR) FROM orders ANTI JOIN customer ON o_custkey = c_custkey
    UNION SELECT 'repeated part name', p_name FROM part GROUP BY p_name HAVING count(*) > 1 UNION SELECT 'negative balance', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0) SELECT invariant, subject FROM v ANTI JOIN (SELECT 'repeated part name' AS invariant, p_name AS subject FROM part WHERE p_size = 1) USING (invariant, subject)"""
)
def identity_invariants(spark, d):
    lineitem, orders, customer, part = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    checks = {
        "line without order": identity.orphans(lineitem, orders, "l_orderkey", "o_orderkey"),
        "order without customer": identity.orphans(orders, customer, "o_custkey", "c_custkey"),
        "repeated part name": identity.repeated(part, "p_name"),
        "negative balance": customer.where("c_acctbal < 0").select("c_custkey"),
    }
    sealed = part.where("p_size = 1").select(F.lit("repeated part name").alias("invariant"), F.col("p_name").alias("subject")).distinct()
    return identity.violations(checks, sealed)


@query(
    """WITH t AS (SELECT p_partkey, p_name, list_transform(regexp_extract_all(p_brand || CASE WHEN p_size % 7 = 0 THEN '.' || p_size ELSE '' END, '[0-9]+'), lambda x: CAST(x AS BIGINT)) AS parts, p_size = 13 AS blocked FROM part), u AS (SELECT *, len(parts) AS arity FROM t),
    tops AS (SELECT p_name, arity, max(parts) AS top, count(*) AS n FROM u WHERE arity > 0 AND NOT blocked GROUP BY 1, 2), totals AS (SELECT p_name, sum(n) AS nf FROM tops GROUP BY 1)
    SELECT p_partkey, CASE WHEN blocked THEN 'BLOCKED' WHEN arity = 0 THEN 'NO_SIGNAL' WHEN parts < top THEN 'SUPERSEDED' WHEN n = 1 AND nf > 1 THEN 'NOT_COMPARABLE' ELSE 'CURRENT' END AS verdict FROM u LEFT JOIN tops USING (p_name, arity) LEFT JOIN totals USING (p_name)"""
)
def revision_verdict(spark, d):
    part = table(spark, d, "part").withColumn("mark", F.concat("p_brand", F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("."), F.col("p_size").cast("string"))).otherwise("")))
    return identity.revision_verdict(part, "p_name", "mark", "p_partkey", F.col("p_size") == 13)


# the corpus


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS canonical, count(*) OVER (PARTITION BY md5(text)) AS n_copies FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, doc_id, 1 FROM documents WHERE text IS NULL")
def exact_duplicates(spark, d):
    return corpus.exact_duplicates(table(spark, d, "documents"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, d):
    return corpus.keep_first(table(spark, d, "documents"), [F.col("source"), F.md5("text")], ["doc_id"]).select("doc_id", "source")


@query()
def page_guard(spark, d):
    return corpus.page_guard(table(spark, d, "pages")).select("page_id", "n_text", "n_plain", "has_blocks", "verdict")


MARK_SQL = ", ".join(f"struct_pack(n := len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in m)}], x))), o := {-i}, lang := '{lang}')" for i, (lang, m) in enumerate(sorted(corpus.MARKERS.items())))


@query(
    f"""WITH h AS (SELECT doc_id, [{MARK_SQL}] AS hits FROM (SELECT doc_id, {sql_words('lower(text)')} AS w FROM documents)), b AS (SELECT doc_id, list_max(hits) AS b, list_sum(list_transform(hits, lambda x: x.n)) AS total FROM h)
    SELECT doc_id, CASE WHEN b.n >= 2 THEN b.lang ELSE 'unknown' END AS guess, round(CASE WHEN total > 0 THEN b.n / total ELSE 0 END, 6) AS confidence FROM b"""
)
def language_markers(spark, d):
    return corpus.language_markers(table(spark, d, "documents")).select("doc_id", "guess", "confidence")


@query(
    """WITH t AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN role END AS lang FROM conversations) SELECT conv_id, turn, coalesce(last_value(lang IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(lang IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM t"""
)
def language_fill(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length("text") % 3 == 0, F.col("role")).alias("lang"))
    return corpus.fill_language(t, "conv_id", "turn", "lang").select("conv_id", "turn", "filled")


@query(
    """WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), g AS (SELECT source, max(CASE WHEN lang IN ('es', 'en') THEN 1 ELSE 0 END) AS hit, min(struct_pack(n := -n, lang := lang)) FILTER (WHERE lang IS NOT NULL) AS top FROM n GROUP BY 1)
    SELECT source, coalesce(top.lang, 'es') AS dominant, CASE WHEN hit = 1 OR top IS NULL THEN 'index' ELSE 'register_only' END AS verdict FROM g"""
)
def document_verdict(spark, d):
    return corpus.document_verdict(table(spark, d, "documents"), "source", "lang")


TOPICS = {"table": (" \\| ",), "contact": ("@",), "legal": ("licen[sc]e", "rights")}
VOTE_SQL = ", ".join(f"struct_pack(n := len(regexp_extract_all({{f}}, '{'|'.join(w)}')), o := {-i}, topic := '{t}')" for i, (t, w) in enumerate(TOPICS.items())).replace("{f}", "f")


@query(f"WITH v AS (SELECT source, list_max([{VOTE_SQL}]) AS b FROM (SELECT source, {sql_fold('text')} AS f FROM documents)) SELECT source, CASE WHEN b.n >= 2 THEN b.topic ELSE 'general' END AS topic, count(*) AS n FROM v GROUP BY 1, 2")
def typology_by_source(spark, d):
    return table(spark, d, "documents").groupBy("source", corpus.topic_vote(F.col("text"), TOPICS).alias("topic")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'done' WHEN coalesce(length(trim(text)), 0) = 0 THEN 'empty' WHEN NOT coalesce(lang IN ('es', 'en'), false) THEN 'empty_after_language' WHEN length(trim(text)) < 300 THEN 'scarce' ELSE 'to_do' END AS status FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def status_ledger(spark, d):
    return corpus.ledger(table(spark, d, "documents"), table(spark, d, "labels"), wanted=F.col("lang").isin("es", "en"))


@query()
def chunk_document(spark, d):
    return corpus.chunk(table(spark, d, "documents"))


@query("SELECT doc_id, regexp_matches(rtrim(text), '\\?[\"'')\\]»]*$') AS question FROM documents")
def question_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_question(F.col("text")).alias("question"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\\s]+', '<url>', 'g'), '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '<mail>', 'g'), '[0-9]{7,}', '<digits>', 'g')) AS redacted_md5 FROM documents")
def redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted_md5"))


# evaluation


def _judged(spark, d):
    """Gold: documents that hold a five-word run of an item; hits: BM25."""
    gold = shingle_containment(spark, d).where("containment >= 0.3").select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"))
    return bm25_rank(spark, d).select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"), "rank"), gold


@query(
    f"""WITH gold AS (SELECT item_id AS query, doc_id AS id FROM ({ORACLE_SQL['shingle_containment']}) WHERE containment >= 0.3), hits AS (SELECT item_id AS query, doc_id AS id, rank FROM ({ORACLE_SQL['bm25_rank']})),
    s AS (SELECT query, count(*) AS n_gold FROM gold GROUP BY 1), g AS (SELECT query, count(*) AS n, min(rank) AS f FROM hits JOIN gold USING (query, id) WHERE rank <= 10 GROUP BY 1)
    SELECT query, n_gold, CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END AS hit, round(coalesce(n, 0) / n_gold, 6) AS recall, round(coalesce(1.0::DOUBLE / f, 0), 6) AS rr FROM s LEFT JOIN g USING (query)"""
)
def ir_metrics(spark, d):
    hits, gold = _judged(spark, d)
    return evaluate.retrieval_metrics(hits, gold, 10)


@query(
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS z, count(*) FILTER (WHERE quality = 1) AS na, count(*) FILTER (WHERE toxic = 1) AS nb FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
    p AS (SELECT n, (b + z) / n AS po, (na * nb + (n - na) * (n - nb)) / (n * n) AS pe FROM c) SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM p"""
)
def kappa_agreement(spark, d):
    return evaluate.kappa(table(spark, d, "labels"), "quality", "toxic")


@query(
    f"""WITH a AS ({sql_list(1)}), b AS ({sql_list(2)}), j AS (SELECT a.query, count(*) AS n, round(median(abs(a.rank - b.rank)), 6) AS m FROM a JOIN b USING (query, id) WHERE a.rank <= 20 AND b.rank <= 20 GROUP BY 1)
    SELECT q.query, round(coalesce(n, 0) / 20.0::DOUBLE, 6) AS overlap, m AS median_shift FROM (SELECT DISTINCT query FROM a) q LEFT JOIN j USING (query)"""
)
def rank_shift(spark, d):
    return evaluate.rank_shift(*_lists(spark, d), 20)


@query(
    """WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'view', 'click') GROUP BY 1, 2), g AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n, min(struct_pack(c := -n, w := list_position(['error', 'view', 'click'], event_type), v := event_type)) AS top FROM v GROUP BY 1)
    SELECT u.user_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < 3 THEN 'error' ELSE top.v END AS verdict FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g USING (user_id)"""
)
def k_majority(spark, d):
    return evaluate.majority(table(spark, d, "events"), "user_id", "event_type", ["error", "view", "click"])


@query("SELECT doc_id, CASE WHEN d.n_chars IS NULL OR quality IS NULL THEN 'broken' WHEN quality > toxic THEN 'better' WHEN quality < toxic THEN 'worse' ELSE 'same' END AS outcome FROM documents d LEFT JOIN labels USING (doc_id)")
def ab_verdict(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", evaluate.pair_class(F.col("toxic"), F.col("quality")).alias("outcome"))


@query()
def bootstrap_ci(spark, d):
    return evaluate.bootstrap_mean(table(spark, d, "events"), "event_type", "value", "event_id")


@query(
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT *, n * 100 / sum(n) OVER () AS share FROM c), r AS (SELECT *, floor(share) AS base, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, source) AS o FROM q), z AS (SELECT source, base + CASE WHEN o <= 100 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM r),
    d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('s' || doc_id), doc_id) AS k FROM documents) SELECT source, doc_id FROM d JOIN z USING (source) WHERE k <= quota"""
)
def stratified_sample(spark, d):
    return evaluate.stratified_sample(table(spark, d, "documents"), "source", "doc_id", 100)


# time windows


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return S.tumbling(S.timed(table(spark, d, "events")))


@query("SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(max(value), 4) AS most FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS h, event_type, value FROM events) GROUP BY 1, 2")
def events_sliding(spark, d):
    return S.sliding(S.timed(table(spark, d, "events")))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_session(spark, d):
    return S.sessions(S.timed(table(spark, d, "events")))


@query("SELECT role, count(DISTINCT struct_pack(conv_id := conv_id, turn := turn)) AS n FROM conversations GROUP BY 1")
def ingress_dedup(spark, d):
    c = table(spark, d, "conversations")
    return S.first_seen(c.union(c), ["conv_id", "turn"]).groupBy("role").agg(F.count("*").alias("n"))
