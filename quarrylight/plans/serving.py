"""Registered queries of the last steps before an answer and of the register's upkeep, each beside its SQL. Roles as in `catalog`;
conversation turns are also fragments that an answer may cite."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import corpus, fusion, identity, serving
from quarrylight.plans import catalog as C
from quarrylight.plans import retrieval  # noqa: F401  its SQL is built upon
from quarrylight.plans.registry import ORACLE_SQL, query
from quarrylight.session import new_dir, table, written
from quarrylight.sources import files
from quarrylight.sources.store import Store

# keyword search that never serves surrogates; both ways to match


def sql_keyword(every_term: bool) -> str:
    whole = ORACLE_SQL["fts_match_rank"].replace("FROM documents", "FROM live").replace("WITH q AS", "WITH live AS (SELECT * FROM documents WHERE doc_id % 5 > 0 AND lang IS DISTINCT FROM 'fr'), q AS", 1)
    if every_term:
        whole = whole.replace("FROM benchmark)", "FROM (SELECT item_id, array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') AS text FROM benchmark))", 1)
        whole = whole.replace("FROM s)", "FROM s JOIN (SELECT item_id, count(*) AS n_query FROM q GROUP BY 1) USING (item_id) WHERE n_terms = n_query)", 1)
    return whole


def _keyword(spark, d, every_term: bool):
    t = F.col("text")
    fields = {"title": (T.tokens(T.heading(t)), 1.0), "content": (T.tokens(T.body(t)), 0.4), "source": (T.tokens(F.col("source")), 0.2)}
    docs = table(spark, d, "documents")
    parent, status = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1), F.when(F.col("lang") == "fr", "superseded")
    items = table(spark, d, "benchmark")
    if every_term:
        items = items.withColumn("text", F.array_join(F.slice(F.split("text", " "), 1, 4), " "))
    return serving.keyword_search(docs, items, fields, T.tokens(t), status, parent, every_term=every_term)


@query(sql_keyword(False))
def keyword_search_live(spark, d):
    return _keyword(spark, d, False)


@query(sql_keyword(True))
def keyword_search_every_term(spark, d):
    return _keyword(spark, d, True)


# each item's candidates are the documents of its number modulo 40; frequencies are those of the candidates


def sql_neighbours(k: int = 10) -> str:
    words = C.sql_tokens("text").replace("{3,}", "{2,}")
    return f"""WITH r AS (SELECT doc_id % 40 AS item_id, doc_id, n_chars % 7 AS page, {words} AS ws FROM documents WHERE doc_id % 40 IN (SELECT item_id FROM benchmark)), z AS (SELECT item_id, count(*) AS nr, avg(len(ws)) AS mean FROM r GROUP BY 1),
    q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({words}) AS t FROM benchmark) GROUP BY 1, 2), tf AS (SELECT item_id, doc_id, n, t, count(*) AS tf FROM (SELECT item_id, doc_id, len(ws) AS n, unnest(ws) AS t FROM r) JOIN q USING (item_id, t) GROUP BY 1, 2, 3, 4), df AS (SELECT item_id, t, count(*) AS df FROM tf GROUP BY 1, 2),
    s AS (SELECT item_id, doc_id, sum(ln(1 + (nr - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) * times) AS score FROM tf JOIN df USING (item_id, t) JOIN q USING (item_id, t) JOIN z USING (item_id) GROUP BY 1, 2)
    SELECT item_id, doc_id, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(score, 0), 6) DESC, page, doc_id) AS rank FROM r LEFT JOIN s USING (item_id, doc_id) QUALIFY rank <= {k}"""


@query(sql_neighbours())
def neighbour_bm25(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("item_id"), "doc_id", (F.col("n_chars") % 7).alias("page"), "text")
    words = T.tokens(F.col("text"), shortest=2)
    return serving.rank_neighbours(rows, table(spark, d, "benchmark"), "item_id", "doc_id", "page", words, words)


# coverage may append to a reranked list and do nothing else; for most labels it does something else

SERVED = f"""pre AS (SELECT query, id, rank AS place, score FROM ({C.sql_list(1, 8)})), more AS (SELECT query, id, 8 + row_number() OVER (PARTITION BY query ORDER BY rank) AS place, score FROM ({C.sql_list(2, 30)}) ANTI JOIN pre USING (query, id)),
    served AS (SELECT query, CASE WHEN query = 1 AND place = 3 THEN -1 ELSE id END AS id, CASE WHEN query = 2 AND place <= 2 THEN 3 - place ELSE place END AS place, score FROM pre WHERE NOT (query = 3 AND place = 8)
        UNION ALL SELECT query, CASE WHEN query = 5 AND place = 10 THEN (SELECT min(id) FROM pre p WHERE p.query = more.query) WHEN query = 6 THEN 7 ELSE id END, place, score FROM more WHERE place <= CASE WHEN query = 4 THEN 13 WHEN query = 3 THEN 0 WHEN query = 7 THEN 8 ELSE 10 END)"""


@query(
    f"""WITH {SERVED}, n AS (SELECT query, count(*) AS n_prefix FROM pre GROUP BY 1), m AS (SELECT query, count(*) AS n_served FROM served GROUP BY 1), k AS (SELECT p.query, count(*) AS n_same FROM pre p JOIN served s ON s.query = p.query AND s.place = p.place AND s.id = p.id AND s.score = p.score GROUP BY 1),
    e AS (SELECT s.query, count(*) - count(DISTINCT s.id) AS rep, count(p.id) AS ins FROM served s JOIN n USING (query) LEFT JOIN pre p ON p.query = s.query AND p.id = s.id WHERE s.place > n_prefix GROUP BY 1),
    v AS (SELECT query, CASE WHEN coalesce(n_served, 0) < n_prefix THEN 'removed' WHEN n_served > n_prefix + {serving.MOST_APPENDED} THEN 'overflow' WHEN coalesce(n_same, 0) < n_prefix THEN 'changed' WHEN coalesce(rep, 0) > 0 OR coalesce(ins, 0) > 0 THEN 'repeated' ELSE 'ok' END AS verdict FROM n LEFT JOIN m USING (query) LEFT JOIN k USING (query) LEFT JOIN e USING (query))
    SELECT query, verdict, place, id FROM served JOIN v USING (query) WHERE verdict = 'ok' UNION ALL SELECT query, verdict, place, id FROM pre JOIN v USING (query) WHERE verdict <> 'ok'"""
)
def protected_prefix(spark, d):
    v, q = table(spark, d, "embeddings"), F.col("query")
    # written: all that follows reads the short lists several times
    lists = [written(fusion.as_list(v, "label", "vec_id", F.round(F.col("embedding")[i].cast("double"), 6), k), "list") for i, k in ((0, 8), (1, 30))]
    pre = lists[0].select("query", F.col("rank").alias("place"), "id", F.col("score").alias("row"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    more = lists[1].join(pre.select("query", "id"), ["query", "id"], "left_anti").select("query", (place + 8).alias("place"), "id", F.col("score").alias("row"))
    least = pre.groupBy("query").agg(F.min("id").alias("least"))
    until = F.when(q == 4, 13).when(q == 3, 0).when(q == 7, 8).otherwise(10)
    added = more.join(least, "query").where(F.col("place") <= until).select("query", "place", F.when((q == 5) & (F.col("place") == 10), F.col("least")).when(q == 6, F.lit(7)).otherwise(F.col("id")).alias("id"), "row")
    kept = pre.where(~((q == 3) & (F.col("place") == 8))).select("query", F.when((q == 2) & (F.col("place") <= 2), 3 - F.col("place")).otherwise(F.col("place")).alias("place"), F.when((q == 1) & (F.col("place") == 3), F.lit(-1)).otherwise(F.col("id")).alias("id"), "row")
    verdicts, lists_ = serving.protected(pre, kept.union(added))
    return lists_.join(verdicts.select("query", "verdict"), "query").select("query", "verdict", "place", "id")


# legends: the last turn of a conversation answers from the turns before it as fragments, and cites some of them

FRAGMENTS = """turns AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations),
    fragments AS (SELECT conv_id, i AS number, CASE WHEN i % 5 = 4 THEN NULL ELSE role || CAST(i AS VARCHAR) || '.pdf' || CASE WHEN i % 2 = 0 THEN ' (2)' ELSE '' END END AS source_file, CASE WHEN i % 3 > 0 THEN split_part(text, ' ', 1) END AS section_title, CASE WHEN length(text) % 4 > 0 THEN length(text) % 90 END AS page_number, CASE WHEN i % 2 = 0 THEN 'https://manuals.example/' || CAST(conv_id AS VARCHAR) WHEN i % 3 = 0 THEN 'ftp://x' END AS url FROM turns WHERE i < k),
    answers AS (SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN text || ' [F1] and [F2], [F1][F9] [F0]' WHEN 1 THEN '[F3]' || text || '[F' || CAST(turn AS VARCHAR) || '] [F2] [F1]' WHEN 2 THEN text || ' Sources: USER1; assistant2' ELSE text END AS answer FROM turns WHERE i = k)"""
LEGEND = {"header": "Sources:", "more": "(+%d more, not listed)", "unknown": "unknown manual"}


@query(
    f"""WITH {FRAGMENTS}, marks AS (SELECT conv_id, TRY_CAST(unnest(regexp_extract_all(answer, '\\[F([0-9]+)\\]', 1)) AS BIGINT) AS number FROM answers), direct AS (SELECT DISTINCT conv_id, number FROM marks SEMI JOIN fragments USING (conv_id, number)),
    named AS (SELECT conv_id, number FROM fragments f JOIN answers a USING (conv_id) WHERE conv_id NOT IN (SELECT conv_id FROM direct) AND trim(regexp_replace(coalesce(source_file, ''), '^(.*)\\.pdf.*$', '\\1')) <> '' AND instr(lower(answer), lower(trim(regexp_replace(source_file, '^(.*)\\.pdf.*$', '\\1')))) > 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY number) AS place, count(*) OVER (PARTITION BY conv_id) AS n_all FROM (SELECT * FROM direct UNION ALL SELECT * FROM named)),
    l AS (SELECT conv_id, number, n_all, '[F' || CAST(number AS VARCHAR) || '] ' || concat_ws(' · ', CASE WHEN coalesce(source_file, '') = '' THEN '{LEGEND["unknown"]}' ELSE regexp_replace(source_file, '^(.*)\\.pdf.*$', '\\1') END, nullif(trim(section_title), ''), 'p. ' || CAST(page_number AS VARCHAR), CASE WHEN url LIKE 'http%' THEN url || coalesce('#page=' || CAST(page_number AS VARCHAR), '') END) AS line FROM c JOIN fragments USING (conv_id, number) WHERE place <= 2)
    SELECT conv_id, concat_ws(chr(10), '{LEGEND["header"]}', string_agg(line, chr(10) ORDER BY number), CASE WHEN max(n_all) > 2 THEN '(+' || CAST(max(n_all) - 2 AS VARCHAR) || ' more, not listed)' END) AS legend FROM l GROUP BY 1"""
)
def source_legends(spark, d):
    w = Window.partitionBy("conv_id")
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.row_number().over(w.orderBy("turn")).alias("i"), F.count("*").over(w).alias("k"))
    i, n, size = F.col("i"), F.when, F.length("text")
    file = n(i % 5 != 4, F.concat("role", i.cast("string"), F.lit(".pdf"), n(i % 2 == 0, " (2)").otherwise("")))
    fragments = t.where("i < k").select("conv_id", i.cast("long").alias("number"), file.alias("source_file"), n(i % 3 > 0, F.split_part("text", F.lit(" "), F.lit(1))).alias("section_title"), n(size % 4 > 0, size % 90).alias("page_number"), n(i % 2 == 0, F.concat(F.lit("https://manuals.example/"), F.col("conv_id").cast("string"))).when(i % 3 == 0, "ftp://x").alias("document_source_url"))
    by, x = F.col("conv_id") % 4, F.col("text")
    answer = n(by == 0, F.concat(x, F.lit(" [F1] and [F2], [F1][F9] [F0]"))).when(by == 1, F.concat(F.lit("[F3]"), x, F.lit("[F"), F.col("turn").cast("string"), F.lit("] [F2] [F1]"))).when(by == 2, F.concat(x, F.lit(" Sources: USER1; assistant2"))).otherwise(x)
    answers = t.where("i = k").select("conv_id", answer.alias("answer"))
    return serving.legend(answers, fragments, **LEGEND, links=True, answer_id="conv_id", most=2)


# the census of broken invariants against its seal, and deletion by a condition


@query(
    f"""WITH v AS ({ORACLE_SQL["identity_invariants"].split("SELECT invariant, subject FROM v")[0].removeprefix("WITH v AS (").rstrip().removesuffix(")")}), s AS (SELECT DISTINCT 'repeated part name' AS invariant, p_name AS subject FROM part WHERE p_size = 1 UNION SELECT 'negative balance', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0)
    SELECT invariant, subject, CASE WHEN s.subject IS NULL THEN 'new' WHEN v.subject IS NULL THEN 'resolved' ELSE 'sealed' END AS state FROM v FULL JOIN s USING (invariant, subject)"""
)
def identity_census(spark, d):
    lineitem, orders, customer, part = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    checks = {
        "line without order": identity.orphans(lineitem, orders, "l_orderkey", "o_orderkey"),
        "order without customer": identity.orphans(orders, customer, "o_custkey", "c_custkey"),
        "repeated part name": identity.repeated(part, "p_name"),
        "negative balance": customer.where("c_acctbal < 0").select("c_custkey"),
    }
    sealed = part.where("p_size = 1").select(F.lit("repeated part name").alias("invariant"), F.col("p_name").alias("subject")).union(customer.where("c_custkey % 3 = 0").select(F.lit("negative balance"), F.col("c_custkey").cast("string")))
    return identity.census(checks, sealed)


@query("SELECT doc_id, lang, source FROM documents WHERE NOT coalesce(lang = 'fr' AND doc_id % 2 = 0 OR source = 'src1', false)")
def delete_by_filter(spark, d):
    store = Store(spark, new_dir(spark, "deleted"))
    store.commit({"documents": table(spark, d, "documents").select("doc_id", "lang", "source")})
    gone = (F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0) | (F.col("source") == "src1")
    store.commit({"documents": files.deleted(store.read("documents"), gone)})
    return store.read("documents")


# SQL of queries that had none


def sql_strip(c: str) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g')"
    t = f"regexp_replace({t}, '</(p|div|h1|h2|h3|li|tr|title|article)>|<br>', chr(10), 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, '<[^>]*>', '', 'g'), '\\n+', chr(10), 'g'), chr(10) || ' ')"


ORACLE_SQL["page_guard"] = f"""WITH t AS (SELECT page_id, html, array_to_string(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: {sql_strip("x")}), chr(10)) AS s, {sql_strip("html")} AS p FROM pages),
    n AS (SELECT page_id, length(s) AS n_text, length(p) AS n_plain, len(regexp_extract_all(html, '<p>')) >= 2 AS has_blocks, s FROM t)
    SELECT page_id, n_text, n_plain, has_blocks, CASE WHEN trim(s) = '' OR NOT has_blocks AND n_text < 0.25 * n_plain AND n_plain - n_text >= 500 THEN 'degenerate' ELSE 'sound' END AS verdict FROM n"""
ORACLE_SQL["embed_batches"] = """WITH RECURSIVE t AS (SELECT source, doc_id, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    b AS (SELECT source, doc_id, i, 0 AS batch, 1 AS n, size AS used FROM t WHERE i = 1
        UNION ALL SELECT t.source, t.doc_id, t.i, CASE WHEN b.n >= 20 OR b.used + t.size > 30000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= 20 OR b.used + t.size > 30000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 20 OR b.used + t.size > 30000 THEN t.size ELSE b.used + t.size END FROM b JOIN t ON t.source IS NOT DISTINCT FROM b.source AND t.i = b.i + 1)
    SELECT source, doc_id, batch FROM b"""

#: Numbers with units do not stand in the driver's texts; some words give way to them here, in and out of order.
UNITS = ("kg", "cm", "mm", "km", "m", "V", "W", "A", "%")
CLAIMS = ((" (?:the|de|la|der) ", " 12.5 kg; "), (" (?:and|et|und|los) ", " 3 to 5 mm. "), (" (?:in|en|mit|que) ", " 9-2 V; "), (" (?:is|les|die|para) ", " 7 m 8 m. "))


def sql_claims() -> str:
    t = "text"
    for a, b in CLAIMS:
        t = f"regexp_replace({t}, '{a}', '{b}', 'g')"
    t = f"translate({t}, '–—−ºµ', '---°u')"
    t = f"regexp_replace({t}, '([0-9]) ([0-9]{{3}})\\b', '\\1\\2', 'g')"
    number = "[0-9]+(?:[.][0-9]+)?"
    pattern = f"({number})(?:\\s*(?:-|to)\\s*({number}))?\\s*({'|'.join(UNITS)})(?:[^A-Za-z0-9]|$)"
    return f"""WITH c AS (SELECT doc_id, replace(unnest(regexp_split_to_array(regexp_replace({t}, '[.]([0-9])', chr(1) || '\\1', 'g'), '[;\\n.]')), chr(1), '.') AS clause FROM documents),
    f AS (SELECT doc_id, clause, len(regexp_extract_all(clause, '{number}')) AS n FROM c), o AS (SELECT doc_id, n, TRY_CAST(regexp_extract(clause, '{pattern}', 1) AS DOUBLE) AS low, TRY_CAST(nullif(regexp_extract(clause, '{pattern}', 2), '') AS DOUBLE) AS top, regexp_extract(clause, '{pattern}', 3) AS unit FROM f WHERE n <= 2 AND len(regexp_extract_all(clause, '{pattern}')) = 1)
    SELECT doc_id, low, coalesce(top, low) AS high, unit FROM o WHERE n = 1 OR low < coalesce(top, low)"""


@query(sql_claims())
def numeric_claims(spark, d):
    t = F.col("text")
    for a, b in CLAIMS:
        t = F.regexp_replace(t, a, b)
    return corpus.numeric_claims(table(spark, d, "documents").select("doc_id", t.alias("text")), UNITS)


# complements of a result list: two documents of each source's first 64, with scores of three needs and facets from their words

FACET_WORDS = ("the", "des", "nicht", "que", "version")
POOL = f"""pool AS (SELECT source AS query, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pool_rank, n_chars % 100 / 100.0::DOUBLE AS base, doc_id % 13 AS hits,
    list_filter([{", ".join(f"CASE WHEN contains(text, '{w}') THEN '{w}' END" for w in FACET_WORDS)}, 'query_alignment'], lambda x: x IS NOT NULL) AS facets, [n_chars % 10 / 10.0::DOUBLE, doc_id % 7 / 6.0::DOUBLE, n_chars % 9 / 8.0::DOUBLE] AS needs FROM documents WHERE source IS NOT NULL QUALIFY pool_rank < 64)"""


def sql_rated(of: str, best: str, gain: str, alike: str) -> str:
    w = serving.WEIGHTS
    worth = f"{w[0]} * {best} + {w[1]} * base + {w[2]} * (least(hits, 10) / 10.0::DOUBLE) + {w[3]} * (least(len(facets) - 1, 3) / 3.0::DOUBLE) + {w[4]} * (least({gain}, 2) / 2.0::DOUBLE) + {w[5]} * (1.0 - pool_rank / 64.0::DOUBLE) - {serving.REDUNDANCY} * {alike}"
    return f"SELECT *, round(({worth})::DOUBLE, 8) AS score FROM {of} QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(({worth})::DOUBLE, 8) DESC, {best} DESC, base DESC, {gain} DESC, hits DESC, pool_rank, CAST(id AS VARCHAR) DESC) = 1"


@query(
    f"""WITH {POOL}, one AS ({sql_rated("pool", "list_max(needs)", "len(facets)", "0")}),
    state AS (SELECT query, id AS first, facets AS seen, needs AS past, CASE WHEN list_max(needs) >= {serving.COVERED} THEN list_filter([1, 2, 3], lambda i: needs[i] < {serving.COVERED}) ELSE list_filter([1, 2, 3], lambda i: i <> list_position(needs, list_max(needs))) END AS open FROM one),
    rest AS (SELECT p.*, coalesce(list_max(list_transform(open, lambda i: p.needs[i])), list_max(p.needs)) AS best, len(list_filter(p.facets, lambda f: NOT list_contains(seen, f))) AS gain,
        CASE WHEN list_dot_product(p.needs, p.needs) > 0 AND list_dot_product(past, past) > 0 THEN list_dot_product(p.needs, past) / (sqrt(list_dot_product(p.needs, p.needs)) * sqrt(list_dot_product(past, past))) ELSE 0.0 END AS alike FROM pool p JOIN state USING (query) WHERE p.id <> first)
    SELECT query, id, 1 AS place, score FROM one UNION ALL SELECT query, id, 2, score FROM ({sql_rated("rest", "best", "gain", "alike")})"""
)
def complement_selection(spark, d):
    n, i, t = F.col("n_chars"), F.col("doc_id"), F.col("text")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    facets = F.filter(F.array(*[F.when(F.contains(t, F.lit(w)), w) for w in FACET_WORDS], F.lit("query_alignment")), lambda x: x.isNotNull())
    rows = table(spark, d, "documents").where("source is not null").withColumn("pool_rank", place).where("pool_rank < 64")
    pool = rows.select(F.col("source").alias("query"), i.alias("id"), "pool_rank", (n % 100 / 100.0).alias("base"), (i % 13).alias("hits"), facets.alias("facets"), F.array(n % 10 / 10.0, i % 7 / 6.0, n % 9 / 8.0).alias("needs"))
    return serving.pick_complements(pool)
