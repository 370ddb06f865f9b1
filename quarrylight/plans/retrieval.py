"""Registered queries of retrieval, policy, passages, document lives and answer scoring, each beside its SQL.

Roles as in `catalog`: documents are chunks (source as file, lang as brand or language), benchmark items questions, lineitem the
pages of orders, events logged turns and pieces of work, embeddings vectors with label as product group.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import corpus, evaluate, fusion, identity, passages, predicates, vector
from quarrylight.plans import analytics as A
from quarrylight.plans import catalog as C
from quarrylight.plans.registry import ORACLE_SQL, query
from quarrylight.session import table

# which rows a search may see


@query(f"WITH s AS ({C.TOPK} AND v.label <> 3 AND v.vec_id % 5 > 0) SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM s WHERE s > 0.1) WHERE rank <= 10")
def vec_topk_live(spark, d):
    v = table(spark, d, "embeddings").withColumns({"status": F.when(F.col("label") == 3, "superseded"), "parent": F.when(F.col("vec_id") % 5 == 0, F.floor(F.col("vec_id") / 10))})
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    rows = v.where(predicates.servable(F.col("status"), F.col("parent"))).drop("status", "parent")
    return vector.top_k(rows, queries, 10, 0.1).withColumn("similarity", F.round("similarity", 6))


@query("WITH t AS (SELECT doc_id, lang, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) SELECT doc_id, before FROM t WHERE lang IS DISTINCT FROM before")
def changed_language(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "documents").withColumn("before", F.lag("lang").over(Window.partitionBy("source").orderBy("doc_id")))
    return t.where(predicates.differs(F.col("lang"), F.col("before"))).select("doc_id", "before")


@query(
    """WITH c AS (SELECT md5(text) AS m, min(doc_id) AS first FROM documents GROUP BY 1) SELECT doc_id, CASE WHEN coalesce(source = 'src1', false) THEN 'register_only' WHEN coalesce(lang NOT IN ('es', 'en'), false) THEN 'unsupported_language' WHEN first < doc_id THEN 'duplicate' ELSE 'eligible' END AS policy
    FROM documents LEFT JOIN c ON md5(text) = m"""
)
def policy_classes(spark, d):
    docs = table(spark, d, "documents")
    first = corpus.exact_duplicates(docs).select("doc_id", F.when(F.col("canonical") < F.col("doc_id"), F.col("canonical")).alias("copy_of"))
    return docs.select("doc_id", "source", "lang").join(first, "doc_id").select("doc_id", predicates.policy_class(F.col("source") == "src1", ~F.col("lang").isin("es", "en"), F.col("copy_of")).alias("policy"))


@query(
    f"""WITH p AS ({ORACLE_SQL['policy_classes']}) SELECT d.doc_id, d.source FROM documents d JOIN p USING (doc_id) SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id
    ANTI JOIN (SELECT conv_id FROM conversations WHERE role = 'system') c ON d.doc_id = c.conv_id WHERE policy = 'eligible'"""
)
def eligible_view(spark, d):
    """Documents that pass the policy, are judged good and are not withdrawn."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    withdrawn = table(spark, d, "conversations").where("role = 'system'").select(F.col("conv_id").alias("doc_id"))
    return docs.join(policy_classes(spark, d).where("policy = 'eligible'"), "doc_id", "left_semi").join(good, "doc_id", "left_semi").join(withdrawn, "doc_id", "left_anti")


@query("SELECT doc_id, coalesce(source IN ('src2', 'src3'), false) OR coalesce(lang IN ('de'), false) AS in_scope FROM documents")
def catalogue_scope(spark, d):
    return table(spark, d, "documents").select("doc_id", predicates.in_scope(F.col("source"), ["src2", "src3"], F.col("lang"), ["de"]).alias("in_scope"))


@query("SELECT p_partkey, coalesce(list_contains(string_split(lower(p_name), ' '), split_part(lower((SELECT min(p_name) FROM part)), ' ', 1)), false) AS allowed FROM part")
def allowed_by_token(spark, d):
    part = table(spark, d, "part")
    key = part.agg(F.min("p_name").alias("n")).first()["n"].lower().split(" ")[0]
    return part.select("p_partkey", predicates.has_token(F.col("p_name"), key).alias("allowed"))


@query("SELECT doc_id, coalesce(regexp_matches(text, '(^|[^0-9])42([^0-9]|$)'), false) AS has_number, coalesce(regexp_matches(lower(text), '(^|[^a-z0-9])mit([^a-z0-9]|$)'), false) AS has_code FROM documents")
def anchor_presence(spark, d):
    return table(spark, d, "documents").select("doc_id", predicates.has_number(F.col("text"), "42").alias("has_number"), predicates.has_code(F.col("text"), "MIT").alias("has_code"))


VARIANTS = {"MACHINERY": ["engine", "pump"], "FURNITURE": ["desk", "engine"]}
VARIANT_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in VARIANTS.items())


@query(
    f"""WITH t AS (SELECT c_custkey, unnest([c_mktsegment, 'desk', c_mktsegment]) AS w, generate_subscripts([1, 2, 3], 1) AS i FROM customer), v AS (SELECT c_custkey, i, unnest(CASE w {VARIANT_SQL} ELSE [w] END) AS name, generate_subscripts(CASE w {VARIANT_SQL} ELSE [w] END, 1) AS j FROM t),
    o AS (SELECT c_custkey, name, min(i * 10 + j) AS place FROM v GROUP BY 1, 2) SELECT c_custkey, name, row_number() OVER (PARTITION BY c_custkey ORDER BY place) - 1 AS ordinal FROM o"""
)
def alias_replacement(spark, d):
    words = F.array("c_mktsegment", F.lit("desk"), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.posexplode(predicates.with_variants(words, VARIANTS)).alias("ordinal", "name"))


MEMBERS = ["in", "in the", "of the", "the"]


@query(
    f"""WITH t AS (SELECT item_id, {C.sql_words('lower(text)')} AS w FROM benchmark), g AS (SELECT item_id, w, i, CASE WHEN w[i] = 'in' AND w[i + 1] = 'the' THEN 'in the' WHEN w[i] = 'of' AND w[i + 1] = 'the' THEN 'of the' WHEN w[i] = 'in' THEN 'in' WHEN w[i] = 'the' AND coalesce(w[i - 1] NOT IN ('in', 'of'), true) THEN 'the' END AS m FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) r)
    SELECT item_id, coalesce(string_agg(m, ',' ORDER BY i) FILTER (WHERE m IS NOT NULL), '') AS members FROM g GROUP BY 1"""
)
def series_members(spark, d):
    words = T.words(F.lower("text"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(predicates.longest_members(words, MEMBERS), ",").alias("members"))


@query(
    """WITH r AS (SELECT doc_id, lang, coalesce(regexp_matches(source, 'src1($|[^0-9])'), false) AS hit FROM documents), c AS (SELECT lang, count(*) FILTER (WHERE hit) AS n FROM r GROUP BY 1) SELECT doc_id FROM r JOIN c ON r.lang IS NOT DISTINCT FROM c.lang WHERE hit OR n < 1"""
)
def question_family_filter(spark, d):
    return fusion.filter_open(table(spark, d, "documents").select("doc_id", "lang", "source"), F.col("source").rlike("src1(?![0-9])"), "lang").select("doc_id")


@query("SELECT doc_id, source FROM (SELECT * FROM documents WHERE contains(text, 'ing ') ORDER BY source, doc_id LIMIT 300) ORDER BY coalesce(lang = 'es', false) DESC, source, doc_id LIMIT 100")
def content_search(spark, d):
    rows = table(spark, d, "documents").where(F.col("text").contains("ing "))
    return fusion.searched(rows, [F.col("source").asc_nulls_last(), F.col("doc_id")], F.col("lang") == "es", 100).select("doc_id", "source")


# documents, their pages and links


@query(
    """WITH w AS (SELECT DISTINCT l_orderkey, 3 AS page FROM lineitem WHERE l_orderkey % 7 = 0), n AS (SELECT l_orderkey, page + o AS page, min(abs(o)) AS off FROM w, (SELECT unnest([0, -1, 1]) AS o) GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, l_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY off, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem JOIN n USING (l_orderkey) WHERE l_linenumber = n.page) WHERE place <= 6"""
)
def page_window(spark, d):
    lines = table(spark, d, "lineitem")
    wanted = lines.where("l_orderkey % 7 = 0").select("l_orderkey", F.lit(3).alias("l_linenumber")).distinct()
    found = passages.page_window(wanted, lines, "l_orderkey", "l_linenumber", ["l_partkey", "l_suppkey", "l_extendedprice"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("SELECT q.conv_id, q.turn, p.doc_id AS parent_id, p.source FROM conversations q JOIN documents p ON q.conv_id = p.doc_id WHERE q.role = 'user'")
def embedded_parent(spark, d):
    questions = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn")
    parents = table(spark, d, "documents").select(F.col("doc_id").alias("parent_id"), "source")
    return questions.join(parents, F.col("conv_id") == F.col("parent_id"))


@query("SELECT c_custkey, coalesce(n, 0) AS n, states FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS states FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def votes_as_lists(spark, d):
    each = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]), ",").alias("states"))
    return table(spark, d, "customer").select("c_custkey").join(each, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "states")


@query(
    f"""WITH RECURSIVE l AS ({C.LINKS}), w AS (SELECT source, target, 1 AS steps FROM l UNION ALL SELECT w.source, l.target, steps + 1 FROM w JOIN l ON w.target = l.source WHERE steps < 400), r AS (SELECT source AS node, min(target) AS family FROM w GROUP BY 1)
    SELECT node, family FROM r UNION SELECT family, family FROM r"""
)
def link_families(spark, d):
    """Components of the redirects: targets are smaller, so a family is named by its last target."""
    return identity.families(C._links(spark, d), "source", "target")


#: Forks and circles besides the redirects: of some orders two above, which lead back, and of some half their number.
BACK = "SELECT o_orderkey AS source, o_orderkey + 2 AS target FROM orders WHERE o_orderkey % 101 = 0 UNION ALL SELECT o_orderkey // 2, o_orderkey FROM orders WHERE o_orderkey % 97 = 0"


@query(f"WITH RECURSIVE l AS ({C.LINKS} UNION ALL {BACK}), w AS (SELECT source, target AS ancestor, 1 AS depth FROM l UNION ALL SELECT w.source, l.target, depth + 1 FROM w JOIN l ON w.ancestor = l.source WHERE depth < 12) SELECT source, ancestor, min(depth) AS depth FROM w WHERE source <> ancestor GROUP BY 1, 2")
def revision_lineage(spark, d):
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    back = orders.where(k % 101 == 0).select(k.alias("source"), (k + 2).alias("target")).union(orders.where(k % 97 == 0).select(F.floor(k / 2), k))
    return identity.lineage(C._links(spark, d).union(back), depth=12)


@query(
    """WITH r AS (SELECT doc_id AS document, md5(text) AS hash, source AS name, lang AS brand, CASE WHEN doc_id % 3 = 0 THEN 'inactive' ELSE 'active' END AS status FROM documents WHERE doc_id % 2 = 0),
    m AS (SELECT doc_id, md5(text) AS hash, source AS name, CASE WHEN doc_id % 7 > 0 THEN lang END AS brand FROM documents),
    h AS (SELECT hash, brand, count(*) FILTER (WHERE status = 'active') AS n, min(document) FILTER (WHERE status = 'active') AS d FROM r GROUP BY 1, 2), g AS (SELECT hash, count(*) FILTER (WHERE status = 'active') AS n, min(document) FILTER (WHERE status = 'active') AS d FROM r GROUP BY 1),
    k AS (SELECT name, brand, count(*) FILTER (WHERE status = 'active') AS n, min(document) FILTER (WHERE status = 'active') AS d FROM r GROUP BY 1, 2),
    j AS (SELECT doc_id, CASE WHEN m.brand IS NOT NULL THEN h.n ELSE g.n END AS n1, CASE WHEN m.brand IS NOT NULL THEN h.d ELSE g.d END AS d1, k.n AS n2, k.d AS d2 FROM m LEFT JOIN h USING (hash, brand) LEFT JOIN g ON m.hash = g.hash LEFT JOIN k ON m.name = k.name AND m.brand = k.brand)
    SELECT doc_id, CASE WHEN coalesce(n1, n2) IS NULL THEN 'no_match' WHEN coalesce(n1, n2) = 1 THEN 'active' WHEN coalesce(n1, n2) > 1 THEN 'ambiguous' ELSE 'only_inactive' END AS state, CASE WHEN coalesce(n1, n2) = 1 THEN CASE WHEN n1 IS NOT NULL THEN d1 ELSE d2 END END AS document FROM j"""
)
def typed_resolution(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"), F.col("source").alias("name"), F.col("lang").alias("brand"))
    registry = docs.where("doc_id % 2 = 0").withColumn("status", F.when(F.col("doc_id") % 3 == 0, "inactive").otherwise("active")).withColumnRenamed("doc_id", "document")
    return identity.resolve_documents(docs.withColumn("brand", F.when(F.col("doc_id") % 7 > 0, F.col("brand"))), registry, "doc_id")


@query(
    """SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS settled, md5(CAST(json_object('person', o_custkey, 'orders', count(*), 'settled', bool_and(o_orderstatus <> 'P'), 'states', list_sort(list(DISTINCT o_orderstatus))) AS VARCHAR)) AS record_md5 FROM orders GROUP BY 1"""
)
def record_json(spark, d):
    settled = F.bool_and(F.col("o_orderstatus") != "P")
    g = table(spark, d, "orders").groupBy("o_custkey").agg(settled.alias("settled"), F.count("*").alias("orders"), F.array_sort(F.collect_set("o_orderstatus")).alias("states"))
    return g.select("o_custkey", "settled", F.md5(F.to_json(F.struct(F.col("o_custkey").alias("person"), "orders", "settled", "states"))).alias("record_md5"))


# names and languages


@query("WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang NOT IN ('fr', 'xx'), n DESC, lang) AS k FROM n) SELECT source, lang, n FROM o WHERE k = 1")
def preferred_mode(spark, d):
    return predicates.preferred_mode(table(spark, d, "documents"), "source", "lang", ["fr", "xx"])


@query("WITH c AS (SELECT unnest(regexp_split_to_array(p_type || '/' || p_name, '[ /]')) AS code, p_brand FROM part) SELECT code, min(p_brand) AS maker, count(DISTINCT p_brand) AS n_makers FROM c WHERE regexp_matches(code, '^[A-Za-z]{4,}$') GROUP BY 1")
def model_dictionary(spark, d):
    codes = table(spark, d, "part").select(F.explode(F.split(F.concat_ws("/", "p_type", "p_name"), "[ /]")).alias("code"), "p_brand")
    return codes.where(F.col("code").rlike("^[A-Za-z]{4,}$")).groupBy("code").agg(F.min("p_brand").alias("maker"), F.count_distinct("p_brand").alias("n_makers"))


BRANDS = [("table", " \\| "), ("mail", "@"), ("years", "20[0-9]{2}"), ("upper", "[A-Z]{4}")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in BRANDS) + " ELSE 'none' END AS brand FROM documents")
def brand_detection(spark, d):
    return table(spark, d, "documents").select("doc_id", predicates.first_rule(F.col("text"), BRANDS, "none").alias("brand"))


FACETS = [("the", "(^|[^a-z])the([^a-z]|$)"), ("and", "(^|[^a-z])and([^a-z]|$)"), ("ing", "ing([^a-z]|$)")]


@query("SELECT item_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in FACETS) + "], lambda x: x IS NOT NULL)[1:2], ',') AS facets FROM benchmark")
def facet_expansion(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(predicates.facets(F.lower("text"), FACETS, multi=True), ",").alias("facets"))


@query(
    """WITH t AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'unknown' ELSE role END AS l FROM conversations), c AS (SELECT conv_id, l, count(*) AS n FROM t WHERE l <> 'unknown' GROUP BY 1, 2), dom AS (SELECT conv_id, l AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, l) AS k FROM c) WHERE k = 1)
    SELECT conv_id, turn, CASE WHEN l = 'unknown' THEN dominant ELSE l END AS lang, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk FROM t LEFT JOIN dom USING (conv_id) WHERE l <> 'system'"""
)
def chunk_language(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length("text") % 3 == 0, "unknown").otherwise(F.col("role")).alias("lang"))
    return corpus.chunk_languages(t, "conv_id", "turn", "lang", ["system"])


# passages


SPANS = """SELECT doc_id, i * {stride} AS s, least(i * {stride} + {size}, length(text)) AS e, substr(text, CAST(i * {stride} + 1 AS BIGINT), {size}) AS quote FROM documents, LATERAL (SELECT unnest(range(0, CAST(greatest(ceil((length(text) - {size}) / {stride}.0::DOUBLE), 0) AS BIGINT) + 1)) AS i) r WHERE length(text) > 0"""


@query(
    f"""WITH f AS ({SPANS.format(size=360, stride=180)}), l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS quote, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents), l1 AS (SELECT doc_id, quote, coalesce(sum(length(quote) + 1) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l0),
    u AS (SELECT doc_id, s, e, quote FROM f UNION SELECT doc_id, s, s + length(quote), quote FROM l1 WHERE trim(quote) <> '' AND length(quote) <= 360) SELECT doc_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends, min(md5(quote)) AS least FROM u GROUP BY 1"""
)
def exact_windows(spark, d):
    w = passages.exact_windows(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.min(F.md5("quote")).alias("least"))


def sql_unit_spans(most: int = 1200, overlap: int = 300) -> str:
    """CTEs that end in spans (doc_id, s, e, quote): windows by recursion, paragraphs between blank lines, lines of long ones."""
    half = most // 2
    stop = f"""SELECT doc_id, t, n, s, CASE WHEN tent < n AND greatest(line, dot) > s THEN greatest(line + 1, dot + 2) ELSE tent END AS e
        FROM (SELECT *, CASE WHEN instr(back, chr(10)) > 0 THEN s + {half} + len(seg) - instr(back, chr(10)) ELSE -9 END AS line, CASE WHEN instr(back, ' .') > 0 THEN s + {half} + len(seg) - instr(back, ' .') - 1 ELSE -9 END AS dot
        FROM (SELECT *, reverse(seg) AS back FROM (SELECT doc_id, t, n, s, least(n, s + {most}) AS tent, substr(t, s + {half} + 1, greatest(least(n, s + {most}) - s - {half}, 0)) AS seg FROM (%s))))"""
    begun = f"SELECT doc_id, t, n, CASE WHEN instr(near, chr(10)) > 0 THEN nxt + instr(near, chr(10)) ELSE nxt END AS s FROM (SELECT *, substr(t, nxt + 1, least(n, nxt + {passages.NEAR}) - nxt) AS near FROM (SELECT doc_id, t, n, greatest(s + 1, e - {overlap}) AS nxt FROM win WHERE e < n))"
    return f"""win AS ({stop % "SELECT doc_id, text AS t, length(text) AS n, CAST(0 AS BIGINT) AS s FROM documents WHERE length(text) > 0"} UNION ALL {stop % begun}),
    marked AS (SELECT doc_id, string_split(regexp_replace(text, '(\\n\\s*\\n)', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS ps, text, length(text) AS n FROM documents WHERE length(text) > 0),
    piece AS (SELECT doc_id, n, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS k FROM marked),
    placed AS (SELECT *, coalesce(sum(length(replace(p, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, lag(trim(p, ' ' || chr(9) || chr(10) || chr(13))) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM piece),
    para AS (SELECT doc_id, text, CASE WHEN i = 2 AND last = '' THEN 0 ELSE off + greatest(instr(p, chr(2)) - 1, 0) END AS s, CASE WHEN i = k AND text LIKE '%' || chr(10) THEN n - 1 ELSE off + length(replace(p, chr(2), '')) END AS e FROM placed),
    paras AS (SELECT doc_id, text, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)) AS quote FROM para),
    lined AS (SELECT doc_id, s, e, unnest(string_split(quote, chr(10))) AS l, generate_subscripts(string_split(quote, chr(10)), 1) AS i, len(string_split(quote, chr(10))) AS k FROM paras WHERE e - s > {most}),
    lines AS (SELECT doc_id, s + coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(l) + CASE WHEN i < k THEN 1 ELSE 0 END AS len, l FROM lined),
    spans AS (SELECT doc_id, s, e FROM win WHERE regexp_matches(substr(t, s + 1, e - s), '\\S') UNION SELECT doc_id, s, e FROM paras WHERE e - s <= {half} AND regexp_matches(quote, '\\S') UNION SELECT doc_id, CAST(s AS BIGINT), CAST(s + len AS BIGINT) FROM lines WHERE len <= {half} AND regexp_matches(l, '\\S'))"""


@query(
    f"""WITH RECURSIVE {sql_unit_spans()} SELECT doc_id, s AS start, e AS "end", 'E' || printf('%03d', row_number() OVER (PARTITION BY doc_id ORDER BY s, e)) || '_' || left(sha256(concat_ws(':', 1, doc_id, s, e, sha256(substr(text, s + 1, e - s)))), 10) AS unit_id FROM spans JOIN documents USING (doc_id)"""
)
def evidence_units(spark, d):
    return passages.evidence_units(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query(
    f"""WITH f AS ({SPANS.format(size=800, stride=400)}), q AS (SELECT item_id, list_distinct({C.sql_tokens('text')}) AS terms FROM benchmark), h AS (SELECT doc_id, s, e, len(list_intersect(list_distinct({C.sql_tokens('quote')}), terms)) AS n FROM f JOIN q ON item_id = doc_id % 40)
    SELECT doc_id, s AS start, e AS "end", n AS n_hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s, e) AS k FROM h) WHERE k = 1"""
)
def best_window(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("terms"))
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id")).join(items, "item_id")
    return passages.best_window(docs, "doc_id", "text", "terms")


@query("SELECT doc_id, md5(left(text, 800) || CASE WHEN instr(left(text, 800), 'tion ') = 0 AND instr(substr(text, 801), 'tion ') > 0 THEN chr(10) || '...' || chr(10) || substr(text, CAST(instr(substr(text, 801), 'tion ') + 800 AS BIGINT), 200) ELSE '' END) AS preview_md5 FROM documents")
def rerank_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(passages.preview(F.col("text"), F.lit("tion "))).alias("preview_md5"))


@query("SELECT doc_id, len(v) AS n, md5(array_to_string(v, ' ')) AS values_md5 FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]*[0-9][a-z0-9]*'))) AS v FROM documents)")
def distinctive_values(spark, d):
    v = passages.distinctive(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(v).alias("n"), F.md5(F.array_join(v, " ")).alias("values_md5"))


@query("SELECT conv_id, turn, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS span, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations")
def predecessor_span(spark, d):
    return corpus.with_predecessor(table(spark, d, "conversations"), "conv_id", "turn", F.length("text"), F.col("role")).select("conv_id", "turn", "span", "heading")


@query()
def embed_batches(spark, d):
    return passages.batches(table(spark, d, "documents"), "source", "doc_id", "text", 20, 30_000)


# ranked lists


@query(f"{C.LISTS} SELECT query, id, score, rank FROM a UNION ALL SELECT query, id, score, 21 FROM (SELECT b.*, row_number() OVER (PARTITION BY query ORDER BY b.rank, id) AS n FROM b WHERE id % 4 = 0 AND query NOT IN (SELECT a.query FROM a JOIN b USING (query, id) WHERE id % 4 = 0)) WHERE n = 1")
def warning_reserve(spark, d):
    a, b = C._lists(spark, d)
    return fusion.reserve_one(a, b, F.col("id") % 4 == 0, [F.col("rank"), F.col("id")])


@query(
    """WITH r AS (SELECT label AS query, vec_id AS id, vec_id % 3 AS need, vec_id % 7 AS source, round(embedding[1]::DOUBLE, 6) AS s FROM embeddings), x AS (SELECT *, row_number() OVER (PARTITION BY query, need, source ORDER BY s DESC, id) AS t, row_number() OVER (PARTITION BY query, need ORDER BY s DESC, id) AS p FROM r),
    y AS (SELECT *, min(p) OVER (PARTITION BY query, need, source) AS lead FROM x WHERE t <= 2), z AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY query, need ORDER BY lead) AS k FROM y) WHERE k <= 2), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, need ORDER BY t, lead) AS turn FROM z) WHERE turn <= 2)
    SELECT query, id, need, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY turn, need) AS place FROM v) WHERE place <= 6"""
)
def source_diverse_parents(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("need"), (F.col("vec_id") % 7).alias("source"), F.round(F.col("embedding")[0].cast("double"), 6).alias("s"))
    return fusion.diverse(rows, "query", "need", "source", [F.desc("s"), F.col("id")]).select("query", "id", "need", "place")


@query(
    """WITH g AS (SELECT l_orderkey, l_linenumber AS line, max(l_returnflag = 'R') AS claim, count(DISTINCT l_partkey) AS facets, count(*) AS hits, max(l_quantity) AS most, round(sum(l_discount), 6) AS score FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, line, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY claim DESC, facets DESC, hits DESC, most DESC, score DESC, abs(line - 3), line) AS place FROM g) WHERE place <= 3"""
)
def neighbour_ranking(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("line")).agg(
        F.max(F.col("l_returnflag") == "R").alias("claim"), F.count_distinct("l_partkey").alias("facets"), F.count("*").alias("hits"), F.max("l_quantity").alias("most"), F.round(F.sum("l_discount"), 6).alias("score")
    )
    order = [F.desc("claim"), F.desc("facets"), F.desc("hits"), F.desc("most"), F.desc("score"), F.abs(F.col("line") - 3), F.col("line")]
    return fusion.best_of(g, "l_orderkey", order, 3).select("l_orderkey", "line", "place")


@query(f"SELECT event_id, CASE WHEN {C.K} % 10 > 0 THEN {C.K} END AS next_try FROM events ORDER BY CASE WHEN {C.K} % 10 > 0 THEN {C.K} END ASC NULLS FIRST, event_id LIMIT 200")
def outbox_poll(spark, d):
    k = A.key_number()
    return table(spark, d, "events").select("event_id", F.when(k % 10 > 0, k).alias("next_try")).orderBy(F.asc_nulls_first("next_try"), "event_id").limit(200)


# reports and work


@query(f"SELECT {C.DAY} AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_errors, count(DISTINCT user_id) AS people FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def health_digest(spark, d):
    return A.digest(table(spark, d, "events"), table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query(
    f"""WITH v AS (SELECT {C.WEEK} AS week, {C.CHANNEL} AS channel, count(*) FILTER (WHERE event_type = 'purchase') AS positive, count(*) FILTER (WHERE event_type = 'error') AS negative FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2), t AS (SELECT {C.WEEK} AS week, {C.CHANNEL} AS channel, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT week, channel, n, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative FROM t LEFT JOIN v USING (week, channel)"""
)
def feedback_by_type(spark, d):
    return A.feedback_by_type(table(spark, d, "events"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'view' THEN 'look' ELSE event_type END AS kind FROM events")
def taxonomy_remap(spark, d):
    return table(spark, d, "events").select("event_id", A.remapped(F.col("event_type"), {"purchase": "buy", "view": "look"}).alias("kind"))


WORK = "CASE event_type WHEN 'error' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'waiting' END"


@query(
    f"""WITH w AS (SELECT event_id, {WORK} AS status, ts + INTERVAL 1 HOUR AS until, CASE WHEN {C.K} >= 20 THEN ts END AS due FROM events), n AS (SELECT *, TIMESTAMP '2024-01-20 12:00:00' AS now FROM w)
    SELECT event_id, CASE WHEN status = 'done' THEN 'done' WHEN status = 'running' AND epoch(now) - epoch(until) > 86400 THEN 'stuck' WHEN status = 'running' AND epoch(now) > floor(epoch(until)) THEN 'reclaimable' WHEN status = 'waiting' AND (due IS NULL OR due <= now) THEN 'due' ELSE 'wait' END AS state FROM n"""
)
def work_states(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    status = F.when(F.col("event_type") == "error", "running").when(F.col("event_type") == "purchase", "done").otherwise("waiting")
    due = F.when(A.key_number() >= 20, F.col("ts"))
    return e.select("event_id", A.work_state(status, F.col("ts") + F.expr("interval 1 hour"), due, F.lit("2024-01-20 12:00:00").cast("timestamp"), 86_400).alias("state"))


@query(f"SELECT event_id, CASE WHEN {C.K} BETWEEN 0 AND 59 THEN {C.K} END AS category, CASE WHEN {C.K} BETWEEN 0 AND 59 THEN true END AS flag FROM events")
def strict_classification(spark, d):
    got = A.classified(F.col("props"), list(range(60)))
    return table(spark, d, "events").select("event_id", got["k"].alias("category"), got["flag"].alias("flag"))


# scoring


GOLD_SQL = f"(SELECT item_id AS query, doc_id AS id FROM ({ORACLE_SQL['shingle_containment']}) WHERE containment >= 0.3)"
HITS_SQL = f"(SELECT item_id AS query, doc_id AS id, rank FROM ({ORACLE_SQL['bm25_rank']}))"


@query(f"WITH gold AS {GOLD_SQL}, hits AS {HITS_SQL}, r AS (SELECT query, min(rank) AS best FROM gold LEFT JOIN hits USING (query, id) GROUP BY 1) SELECT query, best, CASE WHEN best IS NULL THEN 'retrieval' WHEN best <= 5 THEN 'generation' ELSE 'top_k' END AS gap FROM r")
def gap_classes(spark, d):
    hits, gold = C._judged(spark, d)
    best = gold.join(hits, ["query", "id"], "left").groupBy("query").agg(F.min("rank").alias("best"))
    return best.withColumn("gap", evaluate.gap_class(F.col("best")))


@query(f"WITH g AS ({ORACLE_SQL['gap_classes']}) SELECT gap, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr FROM g GROUP BY 1")
def case_report(spark, d):
    return gap_classes(spark, d).groupBy("gap").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"))


@query(f"{C.LISTS} SELECT v.vec_id, CASE WHEN a.rank <= 5 THEN 'synthesis' WHEN a.rank IS NOT NULL THEN 'rerank_miss' WHEN v.label < 8 THEN 'retrieval' ELSE 'corpus_gap' END AS funnel FROM embeddings v LEFT JOIN a ON v.vec_id = a.id")
def funnel_classes(spark, d):
    a, _ = C._lists(spark, d)
    j = table(spark, d, "embeddings").select("vec_id", "label").join(a.select(F.col("id").alias("vec_id"), "rank"), "vec_id", "left")
    return j.select("vec_id", evaluate.funnel_class(F.col("rank") <= 5, F.col("rank").isNotNull(), F.col("label") < 8).alias("funnel"))


@query(f"WITH o AS ({ORACLE_SQL['ab_verdict']}), n AS (SELECT " + ", ".join(f"count(*) FILTER (WHERE outcome = '{x}') AS {x}" for x in ("better", "worse", "same", "broken")) + " FROM o) SELECT *, CASE WHEN broken > 0 THEN 'invalid' WHEN better - worse > 0 THEN 'better' WHEN better - worse < 0 THEN 'worse' ELSE 'same' END AS verdict FROM n")
def ab_overall(spark, d):
    return evaluate.overall(C.ab_verdict(spark, d), "outcome")


ASKS, ADMITS = "(which|what|wh)", "(no |not )"
ANCHOR_SQL = "list_distinct(regexp_extract_all(lower(b.text), '[a-z]*[0-9][a-z0-9]*'))"


@query(
    f"""WITH t AS (SELECT d.doc_id, d.text, {ANCHOR_SQL} AS anchors, list_distinct({C.sql_tokens('b.text')}) AS q, list_distinct({C.sql_tokens('d.text')}) AS c, regexp_extract_all(lower(coalesce(d.text, '')), '[a-z]*[0-9][a-z0-9]*') AS v, l.quality, l.toxic FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40 LEFT JOIN labels l ON l.doc_id = d.doc_id),
    p AS (SELECT *, CASE WHEN len(anchors) > 0 THEN len(list_filter(anchors, lambda x: NOT list_contains(v, x))) = 0 WHEN len(q) > 0 THEN len(list_intersect(q, c)) / len(q)::DOUBLE >= 0.8 END AS present, CASE WHEN contains(text, '?') AND regexp_matches(lower(left(text, 300)), '{ASKS}') THEN 'clarify' WHEN regexp_matches(lower(left(text, 300)), '{ADMITS}') THEN 'admit' ELSE 'answer' END AS behaviour FROM t)
    SELECT doc_id, present, behaviour, CASE WHEN toxic = 1 THEN 'contradiction' WHEN quality = 0 THEN 'fabrication' WHEN present IS NULL THEN 'not_evaluable' WHEN NOT coalesce(behaviour = 'answer', true) THEN 'behaviour' WHEN NOT present THEN 'incomplete' ELSE 'pass' END AS verdict FROM p"""
)
def answer_verdicts(spark, d):
    """Each document as an answer to one item: its facts, its behaviour, and the verdict with the judges' labels."""
    items = table(spark, d, "benchmark").select("item_id", passages.distinctive(F.col("text")).alias("anchors"), F.array_distinct(T.tokens(F.col("text"))).alias("q"))
    docs = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 40).join(items, "item_id").join(table(spark, d, "labels"), "doc_id", "left")
    docs = docs.withColumn("present", evaluate.fact_present(F.col("anchors"), passages.quote_overlap(F.col("q"), T.tokens(F.col("text"))), passages.distinctive(F.col("text"))))
    docs = docs.withColumn("behaviour", evaluate.behaviour(F.col("text"), ASKS, ADMITS))
    scored = F.col("present").isNotNull().cast("int")
    verdict = evaluate.answer_verdict(F.col("toxic") == 1, F.col("quality") == 0, scored, F.coalesce(F.col("present").cast("int"), F.lit(0)), F.col("behaviour") == "answer")
    return docs.select("doc_id", "present", "behaviour", verdict.alias("verdict"))


@query()
def bootstrap_delta_ci(spark, d):
    e = table(spark, d, "events").withColumn("k", A.key_number())
    return evaluate.bootstrap_delta(e, "event_type", "k", "value", "event_id")


# tables of contents: documents as they are, and the same with numbers or dot leaders at the ends of their lines, under a heading

TOC = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '[ ,.]+', ' ..... 12 ' || chr(10), 'g') WHEN 2 THEN 'Table of contents' || chr(10) || regexp_replace(text, '[ ,.]+', ' 7' || chr(10), 'g') WHEN 3 THEN 'Contents page' || chr(10) || regexp_replace(text, '[ ,.]+', ' 3' || chr(10), 'g') ELSE 'Índice' || chr(10) || text END AS text FROM documents"""


@query(
    f"""WITH t AS ({TOC}), l AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '(?m)(?:[.][ \\t]?){{4,}}[ \\t]*([0-9]{{1,4}})[ \\t]*$', 1), lambda x: CAST(x AS INTEGER)) AS dots, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines FROM t),
    e AS (SELECT *, list_transform(list_filter(list_transform(lines, lambda x: regexp_extract(x, '(?:^|[ \\t])([0-9]{{1,4}})[ \\t]*$', 1)), lambda x: x <> ''), lambda x: CAST(x AS INTEGER)) AS ends FROM l),
    r AS (SELECT *, len(list_filter(range(2, len(dots) + 1), lambda i: dots[i] >= dots[i - 1])) AS up_dots, len(list_filter(range(2, len(ends) + 1), lambda i: ends[i] >= ends[i - 1])) AS up_ends FROM e)
    SELECT doc_id, len(dots) >= 4 AND up_dots >= 0.8 * (len(dots) - 1) AND dots[-1] >= 5 OR regexp_matches(left(text, 300), '(?im)^[\\s\\d.·|#*—-]{{0,12}}({corpus.CONTENTS})\\b[^\\n]{{0,40}}$') AND len(lines) >= 8 AND len(ends) >= greatest(5, len(lines) // 2) AND up_ends >= 0.8 * (len(ends) - 1) AND ends[-1] >= 5 AS contents FROM r"""
)
def contents_pages(spark, d):
    t, by, n = F.col("text"), F.col("doc_id") % 5, F.when
    lines = lambda end: F.regexp_replace(t, "[ ,.]+", f" {end}\n")
    text = n(by == 0, t).when(by == 1, F.regexp_replace(t, "[ ,.]+", " ..... 12 \n")).when(by == 2, F.concat(F.lit("Table of contents\n"), lines("7"))).when(by == 3, F.concat(F.lit("Contents page\n"), lines("3"))).otherwise(F.concat(F.lit("Índice\n"), t))
    return table(spark, d, "documents").select("doc_id", corpus.contents_page(text).alias("contents"))
