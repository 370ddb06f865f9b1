"""Registered queries of catalogue mentions, the stored text index, near-copy families, snapshots and section paths, each beside
its SQL. Roles as in `catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import copies, gate, mentions, retention, sections, snapshot, textindex
from quarrylight.plans import catalog as C
from quarrylight.plans.registry import query
from quarrylight.session import new_dir, table
from quarrylight.sources.store import Store

# models of a catalogue in whole texts: names of parts, their brands, codes that stand in pages, beginnings of benchmark items

CODE = "[A-Za-z]+[-/ ]?[0-9]+(?:[-/ ][0-9]+)*"
GAPS = "[-\\t\\n\\x0B\\f\\r /.+]*"
MODELS = f"""models AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT p_brand FROM part UNION SELECT unnest(regexp_extract_all(html, '{CODE}')) FROM pages UNION SELECT array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') FROM benchmark)"""


def _models(d):
    def of(name, column):
        return d(name).select(column.alias("name"))

    codes = F.explode(F.regexp_extract_all("html", F.lit(CODE), 0))
    return of("part", F.col("p_name")).union(of("part", F.col("p_brand"))).union(of("pages", codes)).union(of("benchmark", F.array_join(F.slice(F.split("text", " "), 1, 2), " ")))


def sql_mentions() -> str:
    """The models as one alternation, the longest first. A run of digits stands between Q and Z, so that the end of a run can be
    told; letters beyond ASCII become word signs."""
    marked = lambda c: f"regexp_replace({c}, '([0-9]+)', 'Q\\1Z', 'g')"
    key = lambda c: f"regexp_replace({c}, '[-/ \\t\\n\\x0B\\f\\r]+', '', 'g')"
    parts = "list_filter(regexp_split_to_array(name, '[-/ \\t\\n\\x0B\\f\\r]+'), lambda p: p <> '')"
    base = f"array_to_string(list_slice({parts}, 1, len({parts}) - 1), '-')"
    return f"""WITH {MODELS},
    named AS (SELECT name, 0 AS alias FROM models WHERE name IS NOT NULL UNION SELECT {base}, 1 FROM models WHERE len({parts}) >= 3 AND regexp_matches({base}, '[0-9]')),
    keyed AS (SELECT {C.sql_fold("name")} AS pattern, {key(C.sql_fold("name"))} AS key, alias, name FROM named),
    known AS (SELECT key, arg_min(name, (alias, name)) AS model FROM keyed GROUP BY 1),
    cores AS (SELECT regexp_extract_all(pattern, '[a-z]+|[0-9]+') AS s FROM keyed WHERE regexp_matches(pattern, '[a-z0-9]') GROUP BY 1),
    shaped AS (SELECT array_to_string(s, '') AS word, len(array_to_string(s, '')) + 11 * (len(s) - 1) AS size, replace({marked("array_to_string(s, '~')")}, 'Z~Q', 'Z?~Q?') AS core FROM cores),
    whole AS (SELECT '\\b(' || string_agg(replace(core, '~', '{GAPS}'), '|' ORDER BY size DESC, word) || ')(?:[^Q]|$)' AS pattern FROM shaped),
    found AS (SELECT doc_id, regexp_extract_all({marked(f"regexp_replace({C.sql_fold('text')}, '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC\\pM]', '_', 'g')")}, pattern, 1) AS ms FROM documents, whole),
    listed AS (SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM found),
    named_hits AS (SELECT doc_id, model, min(i) AS i, count(*) AS n FROM listed JOIN known ON key = {key("regexp_replace(m, '[QZ]', '', 'g')")} GROUP BY 1, 2)
    SELECT doc_id, model, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, n FROM named_hits"""


@query(sql_mentions())
def catalogue_mentions(spark, d):
    found = mentions.find(table(spark, d, "documents").select("doc_id", "text"), _models(lambda name: table(spark, d, name)), "name")
    return mentions.by_document(found)


# the stored text index: built on earlier texts, then brought up to date; SQL sees the documents as they are at the end


def _index(spark, d):
    """An index in which every tenth document had another text, some had none yet and some are gone by now."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    t = F.col("text")
    fields = {"title": T.heading(t), "content": T.body(t), "source": F.col("source")}
    index = textindex.TextIndex(Store(spark, new_dir(spark, "index")), {"title": 1.0, "content": 0.4, "source": 0.2})
    early = docs.where("doc_id % 11 <> 4").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("earlier the words\n"), F.reverse("text"))).otherwise(t))
    index.build(early, fields)
    index.update(docs.where("doc_id % 10 = 0 or doc_id % 11 = 4").where("doc_id % 7 <> 3"), fields, removed=docs.where("doc_id % 7 = 3").select("doc_id"))
    return index


def _now(sql: str) -> str:
    return sql.replace("WITH ", "WITH now AS (SELECT * FROM documents WHERE doc_id % 7 <> 3), ", 1).replace("AS toks FROM documents", "AS toks FROM now")


@query(_now(C.sql_bm25(C.sql_tokens("text"), C.sql_tokens("text"))))
def index_bm25(spark, d):
    return _index(spark, d).bm25(table(spark, d, "benchmark"), {"title": 1, "content": 1})


@query(_now(C.sql_bm25(f"list_concat({C.sql_tokens(C.BODY)}, {C.sql_tokens(C.HEAD)}, {C.sql_tokens(C.HEAD)}, {C.sql_tokens(C.HEAD)})", C.sql_tokens("text"), distinct=False)))
def index_bm25_fields(spark, d):
    return _index(spark, d).bm25(table(spark, d, "benchmark"), {"title": 3, "content": 1}, distinct_terms=False)


PHRASE_WORDS = 5


def sql_index_report(k: int = 10) -> str:
    runs = lambda c: f"regexp_extract_all({C.sql_fold(c)}, '[a-z0-9]+')"
    each = lambda c, cols: f"SELECT {cols}, unnest({runs(c)}) AS term, generate_subscripts({runs(c)}, 1) AS at"
    kept = f"length(term) >= 3 AND NOT list_contains({C.STOP}, term)"
    fields = " UNION ALL ".join(f"{each(c, f'doc_id, {w}::DOUBLE AS w')} FROM now" for c, w in ((C.HEAD, 1.0), (C.BODY, 0.4), ("source", 0.2)))
    return f"""WITH now AS (SELECT * FROM documents WHERE doc_id % 7 <> 3), items AS (SELECT item_id, array_to_string(list_slice(string_split(text, ' '), 1, {PHRASE_WORDS}), ' ') AS text FROM benchmark),
    asked AS (SELECT * FROM ({each("text", "item_id")} FROM items) WHERE {kept}), sizes AS (SELECT item_id, count(DISTINCT term) AS n_query, count(*) AS n_places FROM asked GROUP BY 1),
    words AS (SELECT * FROM ({fields}) WHERE term IN (SELECT term FROM asked)),
    best AS (SELECT doc_id, term, max(w) AS w FROM words GROUP BY 1, 2),
    scored AS (SELECT item_id, doc_id, count(*) AS n_terms, round(sum(w), 6) AS score FROM best JOIN (SELECT DISTINCT item_id, term FROM asked) USING (term) GROUP BY 1, 2),
    whole AS (SELECT item_id, doc_id, score FROM scored JOIN sizes USING (item_id) WHERE n_terms = n_query),
    runs AS (SELECT item_id, doc_id FROM words JOIN asked USING (term) JOIN sizes USING (item_id) GROUP BY item_id, doc_id, w, words.at - asked.at, n_places HAVING count(DISTINCT asked.at) = n_places),
    matches AS (SELECT item_id, doc_id, score, 'or' AS how FROM scored UNION ALL SELECT item_id, doc_id, score, 'and' FROM whole UNION ALL SELECT item_id, doc_id, score, 'phrase' FROM whole SEMI JOIN runs USING (item_id, doc_id)),
    hows AS (SELECT item_id, unnest(['and', 'or', 'phrase']) AS how FROM benchmark)
    SELECT item_id, how, 'total' AS what, NULL AS doc_id, count(matches.doc_id) AS val FROM hows LEFT JOIN matches USING (item_id, how) GROUP BY 1, 2
    UNION ALL SELECT item_id, how, 'place', doc_id, val FROM (SELECT *, row_number() OVER (PARTITION BY item_id, how ORDER BY score DESC, doc_id) AS val FROM matches) WHERE val <= {k}"""


@query(sql_index_report())
def index_report(spark, d):
    first = F.array_join(F.slice(F.split("text", " "), 1, PHRASE_WORDS), " ")
    return _index(spark, d).report(table(spark, d, "benchmark").withColumn("text", first))


# the document-local snapshot. The register is dealt from documents in families of six by id, every tenth sixty ids are one family
# that is too long; by the family's number some run in a circle, fork, have two active revisions, a draft or another product


FTS = [["are"], ["que", "est"], ["nicht"], ["version"]]
BIG = "(doc_id // 60) % 10 = 7"
REGISTER = f"""dealt AS (SELECT *, CASE WHEN {BIG} THEN 60 ELSE 6 END AS len, CASE WHEN {BIG} THEN doc_id // 60 ELSE doc_id // 6 END AS fam, CASE WHEN {BIG} THEN doc_id % 60 ELSE doc_id % 6 END AS pos FROM documents),
    placed AS (SELECT *, doc_id - pos AS base, CASE WHEN {BIG} THEN 0 ELSE fam % 10 END AS kind FROM dealt),
    register AS (SELECT doc_id AS id, CASE WHEN {BIG} THEN 'long' ELSE 'family' END || CAST(fam AS VARCHAR) AS document_family, CAST(pos AS VARCHAR) AS revision, CASE WHEN kind = 9 THEN 'fr' ELSE 'es' END AS language, 'manual' AS doc_type, CASE WHEN kind = 8 THEN ' ' ELSE 'maker' END AS manufacturer,
        CASE WHEN kind = 6 AND pos = 2 THEN 'other' ELSE 'product' END AS product_model, coalesce(source, '') || '/' || CAST(doc_id AS VARCHAR) AS source_pdf_filename, sha256(coalesce(text, '')) AS source_pdf_sha256,
        CASE WHEN kind = 5 AND pos = 1 THEN 'draft' WHEN kind = 3 THEN (CASE WHEN pos = 0 THEN 'active' ELSE 'superseded' END) WHEN pos = len - 1 OR kind = 4 AND pos = 0 THEN 'active' ELSE 'superseded' END AS status,
        CASE WHEN kind = 1 THEN base + (pos + len - 1) % len WHEN kind = 3 THEN (CASE WHEN pos = 0 THEN NULL WHEN pos = 1 THEN base + len - 1 ELSE doc_id - 1 END) WHEN kind = 2 AND pos = 3 THEN base + 1 WHEN pos = 0 THEN NULL ELSE doc_id - 1 END AS supersedes_id,
        CASE WHEN kind = 3 THEN (CASE WHEN pos = 0 THEN NULL WHEN pos = len - 1 THEN base + 1 ELSE doc_id + 1 END) WHEN pos = len - 1 THEN NULL ELSE doc_id + 1 END AS superseded_by_id FROM placed)"""
ANCHORS = """anchors AS (SELECT (doc_id // 6) // 2 AS request_id, CAST((doc_id // 6) % 2 + 1 AS INTEGER) AS scope_rank, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE doc_id END AS document_id, CASE WHEN doc_id % 17 = 0 THEN 'XY' WHEN doc_id % 19 = 0 THEN repeat('0', 64) ELSE sha256(coalesce(text, '')) END AS extraction_sha256, coalesce(source, '') || '/' || CAST(doc_id AS VARCHAR) AS source_file FROM documents
        WHERE doc_id % 6 = (CASE WHEN (doc_id // 6) % 10 = 3 THEN 0 ELSE 5 END) OR doc_id % 601 = 0)"""


def sql_snapshot(limit: int = 16, most: int = 3) -> str:
    kept = C.sql_tokens("content")
    match = " OR ".join("(" + " AND ".join(f"list_contains(ws, '{w}')" for w in ws) + ")" for ws in FTS)
    rows = "scope_rank := scope_rank, id := id, document_family := document_family, revision := revision, language := language, doc_type := doc_type, manufacturer := manufacturer, product_model := product_model, source_pdf_filename := source_pdf_filename, source_pdf_sha256 := source_pdf_sha256, status := status, supersedes_id := supersedes_id, superseded_by_id := superseded_by_id"
    return f"""WITH RECURSIVE {REGISTER}, {ANCHORS},
    sizes AS (SELECT request_id, count(*) AS n_anchors FROM anchors GROUP BY 1),
    asked AS (SELECT a.*, document_id IS NOT NULL AND regexp_full_match(extraction_sha256, '[0-9a-f]{{64}}') AND length(trim(source_file)) BETWEEN 1 AND 512 AS anchor_valid FROM anchors a JOIN sizes USING (request_id) WHERE n_anchors <= 2),
    seeds AS (SELECT a.request_id, a.scope_rank, a.anchor_valid, a.extraction_sha256 AS anchor_sha, a.source_file AS anchor_file, r.*, r.id IS NOT NULL AND trim(r.manufacturer) <> '' AS complete FROM asked a LEFT JOIN register r ON a.anchor_valid AND r.id = a.document_id),
    family AS (SELECT s.request_id, s.scope_rank, r.* FROM seeds s JOIN register r ON r.document_family = s.document_family AND r.language = s.language AND r.manufacturer = s.manufacturer WHERE s.complete AND s.language = 'es' QUALIFY row_number() OVER (PARTITION BY s.request_id, s.scope_rank ORDER BY r.id) <= {limit + 1}),
    facts AS (SELECT f.request_id, f.scope_rank, count(*) AS n, count(*) FILTER (WHERE f.status = 'active') AS n_active, count(*) FILTER (WHERE f.supersedes_id IS NULL) AS n_root, count(*) FILTER (WHERE f.status NOT IN ('active', 'superseded')) AS n_invalid, count(*) FILTER (WHERE f.product_model <> s.product_model) AS n_drift FROM family f JOIN seeds s USING (request_id, scope_rank) GROUP BY 1, 2),
    mutual AS (SELECT f.request_id, f.scope_rank, bool_and((f.supersedes_id IS NULL OR EXISTS (SELECT 1 FROM family o WHERE o.request_id = f.request_id AND o.scope_rank = f.scope_rank AND o.id = f.supersedes_id AND o.superseded_by_id = f.id)) AND (f.superseded_by_id IS NULL OR EXISTS (SELECT 1 FROM family o WHERE o.request_id = f.request_id AND o.scope_rank = f.scope_rank AND o.id = f.superseded_by_id AND o.supersedes_id = f.id))) AS reciprocal FROM family f GROUP BY 1, 2),
    walk AS (SELECT f.request_id, f.scope_rank, f.id, [f.id] AS path FROM family f JOIN facts USING (request_id, scope_rank) WHERE n <= {limit} AND f.supersedes_id IS NULL
        UNION ALL SELECT f.request_id, f.scope_rank, f.id, list_append(w.path, f.id) FROM walk w JOIN family f ON f.request_id = w.request_id AND f.scope_rank = w.scope_rank AND f.supersedes_id = w.id WHERE NOT list_contains(w.path, f.id)),
    reached AS (SELECT request_id, scope_rank, count(DISTINCT id) AS n_walked FROM walk GROUP BY 1, 2),
    checks AS (SELECT s.*, coalesce(n, 0) AS n, CASE WHEN NOT anchor_valid THEN 'invalid_anchor_scope' WHEN s.id IS NULL THEN 'document_seed_not_found' WHEN NOT complete THEN 'ambiguous_document_family' WHEN language <> 'es' THEN 'unsupported_document_language'
        WHEN status <> 'active' OR superseded_by_id IS NOT NULL OR source_pdf_sha256 <> anchor_sha OR source_pdf_filename <> anchor_file THEN 'active_revision_not_bound_to_anchor_blob' WHEN n > {limit} THEN 'document_scope_overflow' WHEN n_drift > 0 THEN 'ambiguous_document_family' WHEN n_invalid > 0 THEN 'invalid_revision_status'
        WHEN n_active <> 1 THEN 'ambiguous_active_revision' WHEN n_root <> 1 THEN 'branched_or_cyclic_revision_chain' WHEN NOT reciprocal THEN 'nonreciprocal_revision_chain' WHEN coalesce(n_walked, 0) <> n THEN 'incomplete_revision_chain' ELSE 'ok' END AS reason
        FROM seeds s LEFT JOIN facts USING (request_id, scope_rank) LEFT JOIN mutual USING (request_id, scope_rank) LEFT JOIN reached USING (request_id, scope_rank)),
    served AS (SELECT * FROM checks WHERE reason = 'ok' QUALIFY row_number() OVER (PARTITION BY request_id, id ORDER BY scope_rank) = 1),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents),
    hits AS (SELECT s.request_id, s.scope_rank, s.id AS document_id, s.revision, chunk_index, md5(content) AS content_md5, row_number() OVER (PARTITION BY s.request_id, s.id ORDER BY chunk_index) AS place FROM served s JOIN lines l ON l.doc_id = s.id, LATERAL (SELECT {kept} AS ws) WHERE {match}),
    candidates AS (SELECT * FROM hits WHERE place <= {most + 1}),
    parts AS (SELECT request_id, CASE WHEN n_anchors <= 2 THEN 'ok' ELSE 'invalid_request' END AS input_status,
        (SELECT list(struct_pack(scope_rank := scope_rank, document_id := id, extraction_sha256 := source_pdf_sha256, source_file := source_pdf_filename, language := language, revision := revision, family_rows := n) ORDER BY id) FROM served x WHERE x.request_id = z.request_id) AS authorities,
        (SELECT list(struct_pack({rows}) ORDER BY scope_rank, id) FROM family x WHERE x.request_id = z.request_id) AS document_rows,
        (SELECT list(struct_pack(document_id := document_id, id := document_id * 100000 + chunk_index, chunk_index := chunk_index, content_md5 := content_md5, revision := revision, scope_rank := scope_rank, place := place) ORDER BY document_id, place) FROM candidates x WHERE x.request_id = z.request_id) AS candidates,
        (SELECT list(struct_pack(scope_rank := scope_rank, reason := reason) ORDER BY scope_rank) FROM checks x WHERE x.request_id = z.request_id AND reason <> 'ok') AS rejections,
        (SELECT list(DISTINCT scope_rank ORDER BY scope_rank) FROM candidates x WHERE x.request_id = z.request_id AND place = {most + 1}) AS overflow FROM sizes z)
    SELECT request_id, input_status, CAST(to_json(struct_pack("schema" := 'document_local_snapshot_v1', input_status := input_status, authorities := coalesce(authorities, []), document_rows := coalesce(document_rows, []), candidates := coalesce(candidates, []), rejections := coalesce(rejections, []), family_rows_read := coalesce(len(document_rows), 0), candidate_rows := coalesce(len(candidates), 0), candidate_overflow_scopes := coalesce(overflow, []))) AS VARCHAR) AS snapshot FROM parts"""


@query(sql_snapshot())
def document_snapshot(spark, d):
    docs = table(spark, d, "documents")
    big, n = (F.floor(F.col("doc_id") / 60) % 10) == 7, F.when
    size = n(big, 60).otherwise(6)
    placed = docs.withColumn("big", big).withColumn("len", size).withColumn("fam", F.floor(F.col("doc_id") / F.col("len"))).withColumn("pos", F.col("doc_id") % F.col("len")).withColumn("base", F.col("doc_id") - F.col("pos")).withColumn("kind", n(F.col("big"), 0).otherwise(F.col("fam") % 10))
    kind, pos, last, me, base = F.col("kind"), F.col("pos"), F.col("len") - 1, F.col("doc_id"), F.col("base")
    sha, file = F.sha2(F.coalesce("text", F.lit("")), 256), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), me.cast("string"))
    register = placed.select(
        me.alias("id"), F.concat(n(F.col("big"), "long").otherwise("family"), F.col("fam").cast("string")).alias("document_family"), pos.cast("string").alias("revision"), n(kind == 9, "fr").otherwise("es").alias("language"), F.lit("manual").alias("doc_type"), n(kind == 8, " ").otherwise("maker").alias("manufacturer"),
        n((kind == 6) & (pos == 2), "other").otherwise("product").alias("product_model"), file.alias("source_pdf_filename"), sha.alias("source_pdf_sha256"),
        n((kind == 5) & (pos == 1), "draft").when(kind == 3, n(pos == 0, "active").otherwise("superseded")).when((pos == last) | (kind == 4) & (pos == 0), "active").otherwise("superseded").alias("status"),
        n(kind == 1, base + (pos + last) % F.col("len")).when(kind == 3, n(pos == 1, base + last).when(pos > 1, me - 1)).when((kind == 2) & (pos == 3), base + 1).when(pos > 0, me - 1).alias("supersedes_id"),
        n(kind == 3, n(pos == last, base + 1).when(pos > 0, me + 1)).when(pos < last, me + 1).alias("superseded_by_id"),
    )
    six = F.floor(me / 6)
    anchors = docs.where((me % 6 == n(six % 10 == 3, 0).otherwise(5)) | (me % 601 == 0)).select(
        F.floor(six / 2).alias("request_id"), (six % 2 + 1).cast("int").alias("scope_rank"), n(me % 13 == 0, -1).otherwise(me).alias("document_id"), n(me % 17 == 0, "XY").when(me % 19 == 0, "0" * 64).otherwise(sha).alias("extraction_sha256"), file.alias("source_file")
    )
    chunks = docs.select(me.alias("document_id"), sha.alias("extraction_sha256"), file.alias("source_file"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    chunks = chunks.select("*", (F.col("document_id") * 100000 + F.col("chunk_index")).alias("id"), F.lit(None).cast("long").alias("duplicate_of"), F.md5("content").alias("content_md5"))
    return snapshot.snapshot(anchors, register, chunks, FTS, candidate_limit=3, payload=("content_md5",))


# section paths of a host's pages, one behind the other. The driver's pages have headings of one level; blocks of some lengths
# count as headings of levels 2 to 4 too

HOST = "https?://([^/]+)"


@query(
    f"""WITH found AS (SELECT page_id, regexp_extract(url, '{HOST}', 1) AS host, regexp_extract_all(html, '{sections.BLOCK}') AS pieces FROM pages),
    each AS (SELECT page_id, host, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS block FROM found),
    plain AS (SELECT host, page_id, block, trim(regexp_replace(regexp_replace(piece, '<[^>]*>', ' ', 'g'), '[ \n]+', ' ', 'g'), ' ') AS title, piece FROM each),
    levelled AS (SELECT *, CASE WHEN piece LIKE '<h1%' THEN 1 WHEN length(title) % 5 = 0 THEN 2 + length(title) // 5 % 3 END AS level, row_number() OVER (PARTITION BY host ORDER BY page_id, block) AS i FROM plain),
    tops AS (SELECT l.host, l.page_id, l.block, h.level, max(h.i) AS i FROM levelled l JOIN levelled h ON h.host = l.host AND h.i <= l.i AND h.level IS NOT NULL GROUP BY ALL),
    open AS (SELECT t.* FROM tops t WHERE NOT EXISTS (SELECT 1 FROM tops o WHERE o.host = t.host AND o.page_id = t.page_id AND o.block = t.block AND o.level < t.level AND o.i > t.i))
    SELECT l.host, l.page_id, l.block, coalesce((SELECT string_agg(h.title, ' > ' ORDER BY o.level) FROM open o JOIN levelled h ON h.host = o.host AND h.i = o.i WHERE o.host = l.host AND o.page_id = l.page_id AND o.block = l.block), '') AS path FROM levelled l"""
)
def section_paths(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", HOST, 1).alias("host"), "html")
    size = F.length("title")
    blocks = sections.html_blocks(pages).withColumn("level", F.coalesce("level", F.when(size % 5 == 0, (2 + F.floor(size / 5) % 3).cast("int"))))
    return sections.section_paths(blocks, "host", ["page_id", "block"], "level", "title").select("host", "page_id", "block", F.array_join("path", " > ").alias("path"))


# families of near copies by their least shingles; md5 in the place of crc32, which DuckDB lacks


def sql_near_copies(size: int = copies.SKETCH, words: int = copies.SHINGLE_WORDS, least: float = copies.LEAST) -> str:
    return f"""WITH RECURSIVE split AS (SELECT doc_id, {C.sql_words(C.sql_fold("text"))} AS w FROM documents),
    hashed AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(array_to_string(list_slice(w, i, i + {words - 1}), ' ')), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM split)),
    sketched AS (SELECT doc_id, list(h ORDER BY h)[1:{size}] AS s FROM hashed GROUP BY 1),
    met AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM (SELECT doc_id, unnest(s) AS h FROM sketched) a JOIN (SELECT doc_id, unnest(s) AS h FROM sketched) b ON a.h = b.h AND a.doc_id < b.doc_id),
    joined AS (SELECT a, b, list_sort(list_distinct(list_concat(x.s, y.s)))[1:{size}] AS u, list_intersect(x.s, y.s) AS i FROM met JOIN sketched x ON x.doc_id = a JOIN sketched y ON y.doc_id = b),
    links AS (SELECT a, b FROM joined WHERE len(list_intersect(u, i)) / len(u) >= {least} - 1e-9),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN edges l ON r.other = l.a)
    SELECT doc_id, min(other) AS family, coalesce(any_value(len(s)), 0) AS n_shingles FROM reach LEFT JOIN sketched USING (doc_id) GROUP BY doc_id"""


@query(sql_near_copies())
def near_copy_families(spark, d):
    return copies.near_copies(table(spark, d, "documents"), hashed=copies.md5_number)


# the throttle over a log of failures: each person's events in order, with the state of the gate before each

RULE = gate.Throttle(free=3, base=600.0, most=86_400.0, retention=400_000.0)


@query(
    f"""WITH RECURSIVE tries AS (SELECT CAST(user_id AS VARCHAR) AS zone, event_id AS seq, epoch(ts)::DOUBLE AS secs, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    gate AS (SELECT zone, seq, secs, i, 1 AS n, secs AS last, 0.0::DOUBLE AS wait FROM tries WHERE i = 1
        UNION ALL SELECT zone, seq, secs, i, CASE WHEN w > 0 THEN n WHEN last < secs - {RULE.retention} THEN 1 ELSE n + 1 END, CASE WHEN w > 0 THEN last ELSE secs END, w
        FROM (SELECT t.zone, t.seq, t.secs, t.i, g.n, g.last, CASE WHEN g.n > {RULE.free} THEN greatest(0.0, g.last - t.secs + least({RULE.base} * pow(2.0, least(g.n - {RULE.free} - 1, 60)), {RULE.most})) ELSE 0.0 END AS w FROM gate g JOIN tries t ON t.zone = g.zone AND t.i = g.i + 1))
    SELECT zone, seq, round(wait, 3) AS wait FROM gate"""
)
def throttle_replay(spark, d):
    events = table(spark, d, "events")
    tries = events.select(F.col("user_id").cast("string").alias("zone"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.array(F.col("user_id").cast("string")).alias("keys"))
    return gate.replay(tries, RULE).select("zone", "seq", F.round("wait", 3).alias("wait"))


# a retention pass over several tables as one generation: events and orders lose the person, events of one kind go, and so do
# people whom nothing names any more

KEY, CUTOFF = b"pepper", "2024-01-15"


def sql_hmac(message: str) -> str:
    whole = KEY.ljust(retention.HASH_BLOCK, b"\0")
    pad = lambda p: "unhex('" + bytes(b ^ p for b in whole).hex() + "')"
    return f"sha256({pad(retention.OUTER)} || unhex(sha256({pad(retention.INNER)} || encode(CAST({message} AS VARCHAR)))))"


@query(
    f"""WITH logs AS (SELECT event_id, ts, user_id AS person FROM events WHERE event_type <> 'click'), links AS (SELECT event_id, ts FROM events WHERE event_type = 'click'), people AS (SELECT c_custkey AS person FROM customer),
    kept AS (SELECT event_id, CASE WHEN ts >= TIMESTAMP '{CUTOFF}' THEN person END AS person, CASE WHEN ts < TIMESTAMP '{CUTOFF}' AND person IS NOT NULL THEN {sql_hmac("person")} END AS pseudonym FROM logs),
    named AS (SELECT person FROM kept WHERE person IS NOT NULL UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
    SELECT 'logs' AS part, event_id AS id, person, pseudonym AS note FROM kept UNION ALL SELECT 'links', event_id, NULL, NULL FROM links WHERE ts >= TIMESTAMP '{CUTOFF}' UNION ALL SELECT 'people', person, person, NULL FROM people SEMI JOIN named USING (person)
    UNION ALL SELECT 'receipt', count(*) FILTER (WHERE ts < TIMESTAMP '{CUTOFF}' AND person IS NOT NULL), NULL, 'logs pseudonym' FROM logs UNION ALL SELECT 'receipt', count(*) FILTER (WHERE ts < TIMESTAMP '{CUTOFF}'), NULL, 'links deleted' FROM links UNION ALL SELECT 'receipt', count(*), NULL, 'people mapping' FROM people ANTI JOIN named USING (person)"""
)
def retention_generation(spark, d):
    events = table(spark, d, "events")
    store = Store(spark, new_dir(spark, "retention"))
    tables = {
        "logs": events.where("event_type <> 'click'").select("event_id", "ts", F.col("user_id").alias("person")),
        "links": events.where("event_type = 'click'").select("event_id", "ts"),
        "people": table(spark, d, "customer").select(F.col("c_custkey").alias("person")),
        "orders": table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey"),
    }
    store.commit(tables)
    store.publish(retention.stage(store, retention.Rules(KEY, {"logs": "ts"}, {"links": "ts"}, "people", named=[("orders", "o_custkey")]), CUTOFF, "manual"))
    none = F.lit(None)
    logs = store.read("logs").select(F.lit("logs").alias("part"), F.col("event_id").alias("id"), "person", F.col("pseudonym").alias("note"))
    links = store.read("links").select(F.lit("links"), "event_id", none.cast("long"), none.cast("string"))
    people = store.read("people").select(F.lit("people"), "person", "person", none.cast("string"))
    receipts = store.read("receipts").select(F.lit("receipt"), "touched", none.cast("long"), F.concat_ws(" ", "table", "mode"))
    return logs.union(links).union(people).union(receipts)
