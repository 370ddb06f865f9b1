"""DuckDB SQL for the results of the operators that SQL can express."""

from __future__ import annotations

from quarrylight.llm import divergence as div
from quarrylight.llm import line_dedup as lines
from quarrylight.llm import mixing as mix
from quarrylight.llm import terms

TRIMMED = "trim(line, ' ' || chr(9) || chr(13))"


def line_dedup_ctes(docs: str = "documents", out: str = "cleaned") -> str:
    """CTEs that give `out`: docs with text, n_lines, n_removed after boilerplate removal."""
    return f"""
    {out}_lines AS (SELECT doc_id, source, line, pos FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {docs} WHERE text IS NOT NULL)),
    {out}_boiler AS (SELECT {TRIMMED} AS k FROM {out}_lines WHERE {TRIMMED} <> '' AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= {lines.SITES}),
    {out}_marked AS (SELECT l.*, b.k IS NOT NULL AS gone FROM {out}_lines l LEFT JOIN {out}_boiler b ON {TRIMMED} = b.k),
    {out}_by_doc AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM {out}_marked GROUP BY doc_id),
    {out} AS (SELECT d.* EXCLUDE (text), c.text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed FROM {docs} d LEFT JOIN {out}_by_doc c USING (doc_id))"""


def line_dedup() -> str:
    return f"WITH {line_dedup_ctes()} SELECT doc_id, n_lines, n_removed, md5(text) AS kept_md5 FROM cleaned"


def mixing_ctes(docs: str = "documents", out: str = "mixed") -> str:
    """CTEs that give `out`: docs with topic, n_tokens, probability, selected."""
    t = "coalesce(text, '')"
    axes = ("s", "l", "topic")
    legal = " OR ".join(f"contains(lower({t}), '{x}')" for x in mix.LEGAL)
    parts = [
        f"""{out}_rows AS (SELECT *, coalesce(source, '{mix.NONE}') AS s, coalesce(lang, '{mix.NONE}') AS l,
        CASE WHEN {legal} THEN 'legal' WHEN contains({t}, ' | ') THEN 'table' WHEN contains({t}, '@') THEN 'contact' WHEN regexp_matches({t}, '[#$%&*]{{3}}') THEN 'symbols' WHEN regexp_matches({t}, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
        CAST(len(list_filter(regexp_split_to_array({t}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM {docs})""",
        f"{out}_cells AS (SELECT s, l, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM {out}_rows GROUP BY ALL HAVING sum(n_tokens) > 0)",
        f"{out}_goal AS (SELECT sum(tokens) * {mix.BUDGET} AS goal FROM {out}_cells)",
    ]
    for a in axes:  # values that are used up come first in the order of tokens by share
        parts.append(f"{out}_share_{a} AS (SELECT {a}, sum(tokens) AS t, pow(sum(tokens), {mix.SOFTEN}) AS p FROM {out}_cells GROUP BY 1)")
        parts.append(f"{out}_left_{a} AS (SELECT *, goal - coalesce(sum(t) OVER (ORDER BY t / p, {a} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(p) OVER (ORDER BY t / p, {a} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS of, row_number() OVER (ORDER BY t / p, {a}) AS i FROM {out}_share_{a}, {out}_goal)")
        parts.append(f"{out}_target_{a} AS (SELECT {a}, least(t, p * coalesce((SELECT arg_min(rest / of, i) FROM {out}_left_{a} WHERE rest / of < t / p), t / p)) AS target_{a} FROM {out}_share_{a})")
    columns = "s, l, topic, tokens, target_s, target_l, target_topic"

    def scaled(a: str, of: str) -> str:
        sums = {"all_": "weight", "full_": f"CASE WHEN weight >= tokens * {mix.USED_UP} THEN tokens ELSE 0 END", "free_": f"CASE WHEN weight >= tokens * {mix.USED_UP} THEN 0 ELSE weight END"}
        over = ", ".join(f"sum({v}) OVER (PARTITION BY {a}) AS {k}" for k, v in sums.items())
        factor = f"CASE WHEN target_{a} > full_ AND free_ > 0 THEN (target_{a} - full_) / free_ WHEN target_{a} < full_ OR free_ > 0 THEN target_{a} / all_ ELSE 1 END"
        return f"SELECT k, {columns}, weight * {factor} AS weight FROM (SELECT *, {over} FROM ({of}))"

    gaps = ", ".join(f"sum(abs(m_{a} - target_{a}) / n_{a}) OVER () / goal" for a in axes)
    sums = ", ".join(f"sum(least(weight, tokens)) OVER (PARTITION BY {a}) AS m_{a}, count(*) OVER (PARTITION BY {a}) AS n_{a}" for a in axes)
    measured = lambda of: f"SELECT k, {columns}, weight, greatest({gaps}) AS gap FROM (SELECT *, {sums} FROM ({of})), {out}_goal"
    begin = f"SELECT 0 AS k, {columns}, tokens * {mix.BUDGET} AS weight FROM {out}_cells JOIN {out}_target_s USING (s) JOIN {out}_target_l USING (l) JOIN {out}_target_topic USING (topic)"
    step = scaled("topic", scaled("l", scaled("s", f"SELECT k + 1 AS k, {columns}, weight FROM {out}_raked WHERE gap > {mix.TOLERANCE} AND k < {mix.ROUNDS}")))
    parts.append(f"{out}_raked AS ({measured(begin)} UNION ALL {measured(step)})")
    parts.append(f"{out}_chance AS (SELECT s, l, topic, least(1.0, weight / tokens) AS probability FROM {out}_raked WHERE k = (SELECT max(k) FROM {out}_raked))")
    parts.append(
        f"""{out} AS (SELECT r.* EXCLUDE (s, l), CASE WHEN n_tokens > 0 THEN coalesce(p.probability, 0) ELSE 0 END AS probability,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < CASE WHEN n_tokens > 0 THEN coalesce(p.probability, 0) ELSE 0 END AS selected
        FROM {out}_rows r LEFT JOIN {out}_chance p USING (s, l, topic))"""
    )
    return ",\n".join(parts)


def mixing() -> str:
    return f"WITH RECURSIVE {mixing_ctes()} SELECT doc_id, topic, n_tokens, round(CAST(probability AS DOUBLE), 6) AS probability, selected FROM mixed"


def _terms(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{terms.UPPER}', '{terms.LOWER}'), '{pattern}')"


def ranked_search(k: int = 20) -> str:
    own = _terms("text", terms.LETTER_OR_DIGIT_RUN)
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {own} AS ts FROM documents WHERE doc_id IS NOT NULL),
    sums AS (SELECT count(*) AS all_docs, CAST(sum(len(ts)) AS BIGINT) AS all_terms FROM texts WHERE len(ts) > 0),
    asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({own}) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
    postings AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM texts) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
    weights AS (SELECT t, CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, sums GROUP BY t, all_docs),
    lengths AS (SELECT r, doc_id, 100 - 25 + (25 * len(ts) * all_docs) // all_terms AS m FROM texts, sums WHERE len(ts) > 0),
    scores AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM postings JOIN weights USING (t) JOIN lengths USING (r) JOIN asked USING (t) GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= {k}"""


def divergence() -> str:
    """Every group gives every kept term of its language a value, absent or not."""
    p = lambda n, all_: f"1 + ({div.SCALE}::HUGEINT * ({n} + {div.SMOOTHING})) // ({all_} + {div.SMOOTHING} * v)"
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_terms("text", terms.LETTER_RUN)} AS ts FROM documents),
    used AS (SELECT r, lang, source, unnest(ts) AS term FROM texts),
    often AS (SELECT lang, term FROM used GROUP BY ALL HAVING count(DISTINCT r) >= {div.LEAST_DOCS}),
    counts AS (SELECT lang, source, term, count(*) AS n FROM used SEMI JOIN often USING (lang, term) GROUP BY ALL),
    sources AS (SELECT DISTINCT lang, source FROM texts),
    dense AS (SELECT s.lang, s.source, o.term, coalesce(c.n, 0) AS n FROM sources s JOIN often o USING (lang) LEFT JOIN counts c USING (lang, source, term)),
    sums AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS n_all, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_all, count(*) OVER (PARTITION BY lang, source) AS v FROM dense),
    shares AS (SELECT lang, source, term, n, {p("n", "n_all")} AS p, {p("lang_n", "lang_all")} AS q FROM sums),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
    parts AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q)
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts QUALIFY part = 'pair' OR rank <= {div.TOP}"""
