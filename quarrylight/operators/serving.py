"""The last steps before an answer is shown: keyword search over servable rows, neighbours ranked on their own statistics, the
reranked prefix kept, and the legend of the sources that an answer cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators import lexical, predicates
from quarrylight.operators.lexical import K1, B
from quarrylight.session import written

#: Marks of citations, entries of a legend, signs of a link, rows that coverage may append. Fixed values.
CITATION = r"\[F([0-9]+)\]"
MOST_ENTRIES, MOST_LINK, MOST_APPENDED = 12, 300, 4


def keyword_search(docs: DataFrame, queries: DataFrame, fields: dict[str, tuple[Column, float]], query_tokens: Column, status: Column, parent: Column, doc_id: str = "doc_id", query_id: str = "item_id", k: int = 10, every_term: bool = False) -> DataFrame:
    """`lexical.weighted_match` over rows that may be served: surrogates, which have a parent, and rows that are no longer live are
    left out before anything is matched or ranked, so they take no place either."""
    return lexical.weighted_match(docs.where(predicates.servable(status, parent)), queries, fields, query_tokens, doc_id, query_id, k, every_term)


def rank_neighbours(candidates: DataFrame, queries: DataFrame, group: str, row_id: str, page: str, words: Column, query_words: Column, k: int = 10) -> DataFrame:
    """(group, row_id, score, rank): the rows of each group by BM25 against the group's own query; document frequencies, number
    and mean length are those of the group's candidates. A query's words count as often as they stand in it. Rows without a
    hit score 0 and are ranked too; ties by page (null as 0), then id. queries: one row for each group."""
    rows = candidates.where(F.col(group).isNotNull()).select(group, row_id, F.coalesce(page, F.lit(0)).alias("page"), words.alias("words"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n_rows"), F.avg(F.size("words")).alias("mean"))
    asked = queries.where(F.col(group).isNotNull()).select(group, F.explode(query_words).alias("term")).groupBy(group, "term").agg(F.count("*").alias("times"))
    tf = rows.select(group, row_id, F.size("words").alias("len"), F.explode("words").alias("term")).join(asked.select(group, "term"), [group, "term"], "left_semi").groupBy(group, row_id, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(group, "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    scored = tf.join(df, [group, "term"]).join(asked, [group, "term"]).join(sizes, group).groupBy(group, row_id).agg(F.sum(idf * gain * F.col("times")).alias("score"))
    every = rows.join(queries.select(group), group, "left_semi").select(group, row_id, "page").join(scored, [group, row_id], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "page", row_id))
    return every.withColumn("rank", place).where(F.col("rank") <= k).select(group, row_id, "score", "rank")


def protected(reranked: DataFrame, served: DataFrame, most: int = MOST_APPENDED) -> tuple[DataFrame, DataFrame]:
    """(verdicts, lists) of coverage that may only append to a reranked list. Both frames: query, place (from 1), id, row (what must
    not change). verdict: `removed` if rows of the prefix are missing, `overflow` if more than `most` were appended, `changed` if
    the prefix has other rows or another order, `repeated` if an appended id is null, stands twice or in the prefix, else `ok`.
    lists (query, place, id): served where it is ok, else reranked as it was."""
    a = reranked.select("query", "place", "id", "row")
    sizes = a.groupBy("query").agg(F.count("*").alias("n_prefix"))
    b = served.select("query", F.col("place"), F.col("id").alias("served_id"), F.col("row").alias("served_row"))
    totals = b.groupBy("query").agg(F.count("*").alias("n_served"))
    same = F.col("id").eqNullSafe(F.col("served_id")) & F.col("row").eqNullSafe(F.col("served_row"))
    kept = a.join(b, ["query", "place"], "left").groupBy("query").agg(F.count_if(same).alias("n_same"))
    added = b.join(sizes, "query").where(F.col("place") > F.col("n_prefix")).select("query", F.col("served_id").alias("id"))
    inside = added.join(a.select("query", "id"), ["query", "id"], "left_semi").select("query").distinct().withColumn("inside", F.lit(True))
    twice = added.groupBy("query").agg((F.count("*") > F.count_distinct("id")).alias("twice"))  # nulls are not counted as ids
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    verdict = (
        F.when(n("n_served") < F.col("n_prefix"), "removed")
        .when(n("n_served") > F.col("n_prefix") + most, "overflow")
        .when(n("n_same") < F.col("n_prefix"), "changed")
        .when(F.coalesce("inside", F.lit(False)) | F.coalesce("twice", F.lit(False)), "repeated")
        .otherwise("ok")
    )
    joined = sizes.join(totals, "query", "left").join(kept, "query", "left").join(inside, "query", "left").join(twice, "query", "left")
    verdicts = joined.select("query", verdict.alias("verdict"), "n_prefix", n("n_served").alias("n_served"))
    good = verdicts.where("verdict = 'ok'").select("query")
    whole = served.join(good, "query", "left_semi").union(reranked.join(good, "query", "left_anti")).select("query", "place", "id")
    return verdicts, whole


def cited(answers: DataFrame, chunks: DataFrame, answer_id: str = "answer_id") -> DataFrame:
    """(answer_id, number, n, first): the fragments that an answer cites as [F<number>], how often and where first. An answer that
    cites none of its fragments so cites those whose manual it names, once each, where the name first stands.

    answers: answer_id, answer; chunks: answer_id, number (from 1), source_file and what `legend` shows."""
    size = chunks.groupBy(answer_id).agg(F.max("number").alias("n_chunks"))
    marks = F.regexp_extract_all("answer", F.lit(CITATION), 1)
    pieces = F.split("answer", CITATION)  # what stands before each mark tells its place
    each = answers.select(answer_id, F.posexplode(marks).alias("i", "digits"), pieces.alias("pieces"), marks.alias("all"))
    before = lambda xs, extra: F.aggregate(F.transform(xs, lambda x: F.length(x) + extra), F.lit(0), lambda s, x: s + x)
    at = before(F.slice("pieces", F.lit(1), F.col("i") + 1), 0) + before(F.slice("all", F.lit(1), F.col("i")), 3)
    found = each.select(answer_id, F.col("digits").try_cast("long").alias("number"), at.alias("at")).join(size, answer_id).where(F.col("number").between(1, F.col("n_chunks")))
    # written: both sides of the union below would lie by answer, and Spark 4.1 fails to line such a union up in later joins
    direct = written(found.groupBy(answer_id, "number").agg(F.count("*").alias("n"), F.min("at").alias("first")), "cited")
    named = chunks.join(answers.join(direct.select(answer_id).distinct(), answer_id, "left_anti"), answer_id)
    name = F.lower(F.trim(manual(F.col("source_file"))))
    place = F.instr(F.lower("answer"), name)
    by_name = named.where(name != "").select(answer_id, "number", F.lit(1).cast("long").alias("n"), (place - 1).cast("int").alias("first")).where("first >= 0")
    return direct.select(answer_id, "number", "n", F.col("first").cast("int").alias("first")).union(by_name)


def manual(source_file: Column) -> Column:
    """A file's name without its last `.pdf` and what follows."""
    return F.regexp_replace(F.coalesce(source_file, F.lit("")), r"(?s)^(.*)\.pdf.*$", "$1")


def legend(answers: DataFrame, chunks: DataFrame, header: str, more: str, unknown: str, links: bool = False, answer_id: str = "answer_id", most: int = MOST_ENTRIES) -> DataFrame:
    """(answer_id, legend): a line for each cited fragment, ascending: its number, manual, section, page, and with `links` the
    manual's address if it is a plain web address. Beyond `most` lines the rest is counted, as `more` % n. Answers that cite
    nothing have no row.

    chunks: answer_id, number, source_file, section_title, page_number, document_source_url."""
    all_ = cited(answers, chunks, answer_id).select(answer_id, "number").distinct()
    place = F.row_number().over(Window.partitionBy(answer_id).orderBy("number"))  # the fragments of one answer
    ranked = all_.withColumn("place", place).join(all_.groupBy(answer_id).agg(F.count("*").alias("n_all")), answer_id).where(F.col("place") <= most)
    rows = ranked.join(chunks, [answer_id, "number"])
    page, url = F.col("page_number").cast("string"), F.trim("document_source_url")
    sound = url.rlike("^https?://") & ~url.rlike("[ \n]") & (F.length(url) <= MOST_LINK)
    parts = [
        F.when(F.coalesce("source_file", F.lit("")) == "", unknown).otherwise(manual(F.col("source_file"))),
        F.nullif(F.trim("section_title"), F.lit("")),
        F.concat(F.lit("p. "), page),
        *([F.when(sound, F.concat(url, F.coalesce(F.concat(F.lit("#page="), page), F.lit(""))))] if links else []),
    ]
    line = F.concat(F.lit("[F"), F.col("number").cast("string"), F.lit("] "), F.concat_ws(" · ", *parts))
    listed = rows.groupBy(answer_id).agg(F.sort_array(F.collect_list(F.struct("number", line.alias("line")))).alias("lines"), F.max("n_all").alias("n_all"))  # `most` lines
    rest = F.when(F.col("n_all") > most, F.format_string(more, F.col("n_all") - most))
    return listed.select(answer_id, F.concat_ws("\n", F.lit(header), F.transform("lines", lambda x: x["line"]), rest).alias("legend"))


#: Weights of the best uncovered need, the base score, alignment, facets, new facets and the place in the pool; what likeness to a
#: row picked before takes off; a need counts as covered from here on. Fixed values.
WEIGHTS = (0.35, 0.35, 0.15, 0.05, 0.05, 0.05)
REDUNDANCY, COVERED = 0.12, 0.8


def pick_complements(pool: DataFrame, picked: int = 2, pool_limit: int = 64, common_facet: str = "query_alignment") -> DataFrame:
    """(query, id, place, score): rows of a pool picked one after another, each for what the ones before leave uncovered.

    pool: query, id, pool_rank (from 0), base, hits (aligned terms), facets (array<string>), needs (array<double>, one score for
    each need of the query). A row's worth is the weighted sum of its best score among uncovered needs, base, hits (10 at most),
    facets (3 at most, without the common one), facets not yet covered (2 at most) and place, less REDUNDANCY times the largest
    cosine of its needs with those of a picked row. Ties: best need, base, new facets, hits, place, then the larger id as a
    string. A pick covers its facets and every need it scores COVERED on, or else the open need it scores best on. A pool is a
    result list, so its rows meet in one window."""
    left = pool.select("query", "id", "pool_rank", "base", "hits", F.array_distinct("facets").alias("facets"), "needs")
    left = left.withColumns({"open": F.sequence(F.lit(0), F.greatest(F.size("needs") - 1, F.lit(0))), "seen": F.array().cast("array<string>"), "past": F.array().cast("array<array<double>>")})
    left = left.withColumn("open", F.when(F.size("needs") > 0, F.col("open")).otherwise(F.array().cast("array<int>")))
    out = None
    for place in range(1, picked + 1):
        best = F.coalesce(F.array_max(F.transform("open", lambda i: F.get("needs", i))), F.array_max("needs"), F.lit(0.0))
        gain = F.size(F.array_except("facets", "seen"))
        prior = 1.0 - F.least(F.col("pool_rank"), F.lit(pool_limit - 1)) / F.lit(float(pool_limit))
        signal = F.size(F.array_except("facets", F.array(F.lit(common_facet))))
        parts = (best, F.col("base"), F.least(F.col("hits"), F.lit(10)) / 10.0, F.least(signal, F.lit(3)) / 3.0, F.least(gain, F.lit(2)) / 2.0, prior)
        worth = sum((w * x for w, x in zip(WEIGHTS[1:], parts[1:], strict=True)), WEIGHTS[0] * parts[0])
        alike = F.coalesce(F.array_max(F.transform("past", lambda p: _cosine(F.col("needs"), p))), F.lit(0.0))
        rated = left.withColumns({"score": F.round(worth - REDUNDANCY * alike, 8), "best": best, "gain": gain})
        order = [F.desc("score"), F.desc("best"), F.desc("base"), F.desc("gain"), F.desc("hits"), F.asc("pool_rank"), F.desc(F.col("id").cast("string"))]
        ranked = rated.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
        first = ranked.where("n = 1").select("query", "id", F.lit(place).alias("place"), "score")
        out = first if out is None else out.union(first)
        winner = F.max(F.when(F.col("n") == 1, F.struct("facets", "needs"))).over(Window.partitionBy("query"))
        rest = ranked.withColumn("winner", winner).where("n > 1")
        got = F.col("winner.needs")
        strong = F.filter("open", lambda i: F.get(got, i) >= COVERED)
        weakest_open = F.transform("open", lambda i: F.struct(F.get(got, i).alias("s"), (-i).alias("i")))
        done = F.when(F.size(strong) > 0, strong).when(F.size("open") > 0, F.array(-F.array_max(weakest_open)["i"])).otherwise(F.array().cast("array<int>"))
        left = rest.select("query", "id", "pool_rank", "base", "hits", "facets", "needs", F.array_except("open", done).alias("open"), F.array_union("seen", "winner.facets").alias("seen"), F.concat("past", F.array(got)).alias("past"))
    return out


def _cosine(a: Column, b: Column) -> Column:
    """0 for an array without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
