"""Building the corpus: page guard, languages, chunks, claims, duplicates, ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T

#: Frequent function words that mark a language. Fixed values.
MARKERS = {
    "de": ("der", "die", "und", "das", "den", "nicht", "ist", "mit", "ein", "dem"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "was", "with"),
    "es": ("el", "los", "las", "que", "una", "por", "con", "para", "del", "como"),
    "fr": ("le", "les", "des", "et", "une", "que", "dans", "pour", "du", "est"),
}


def page_guard(pages: DataFrame, html: str = "html", least: float = 0.25, loss: int = 500) -> DataFrame:
    """pages with n_text, n_plain, has_blocks, verdict: `degenerate` if the structured text is blank, or if it has no paragraphs
    and is less than `least` of the plain text with `loss` signs lost; then the plain text is to be used. Else `sound`."""
    structured = F.array_join(F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), 1), T.strip_markup), "\n")
    plain = T.strip_markup(F.col(html))
    n_s, n_p = F.length(structured), F.length(plain)
    blocks = F.regexp_count(F.coalesce(F.col(html), F.lit("")), F.lit("<p>")) >= 2
    bad = (F.btrim(structured) == "") | (~blocks & (n_s < least * n_p) & (n_p - n_s >= loss))
    return pages.withColumns({"n_text": F.coalesce(n_s, F.lit(0)), "n_plain": F.coalesce(n_p, F.lit(0)), "has_blocks": blocks}).withColumn("verdict", F.when(F.coalesce(bad, F.lit(True)), "degenerate").otherwise("sound"))


def language_markers(docs: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """docs with guess and confidence: the language whose marker words are most frequent, `unknown` under `least` hits; ties by
    name. confidence: its share of all marker hits."""

    def count(w: Column, marks: tuple[str, ...]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(*marks)))

    tally = lambda w: F.array(*[F.struct(count(w, m).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, m) in enumerate(sorted(MARKERS.items()))])
    hits = T.let(T.words(F.lower(text)), tally)
    best = F.array_max("_hits")
    total = F.aggregate("_hits", F.lit(0), lambda s, x: s + x["n"])
    counted = docs.withColumn("_hits", hits)
    return counted.withColumns({"guess": F.when(best["n"] >= least, best["lang"]).otherwise("unknown"), "confidence": F.round(F.when(total > 0, best["n"] / total).otherwise(0.0), 6)}).drop("_hits")


def fill_language(turns: DataFrame, group: str, order: str, lang: str) -> DataFrame:
    """Unknown (null) languages take the last known one before them, leading ones the first known after."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.last(lang, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(lang, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return turns.withColumn("filled", F.coalesce(before, after))


def document_verdict(pages: DataFrame, group: str, lang: str, wanted: tuple[str, ...] = ("es", "en")) -> DataFrame:
    """(group, dominant, verdict): index if a page is in a wanted language or all are unknown, else register_only. dominant: most
    frequent known language, ties by name; the first wanted one if none is known."""
    n = pages.groupBy(group, lang).agg(F.count("*").alias("n"))
    g = n.groupBy(group).agg(F.max(F.when(F.col(lang).isin(*wanted), 1).otherwise(0)).alias("hit"), F.min(F.when(F.col(lang).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(lang).alias("lang")))).alias("top"))
    return g.select(group, F.coalesce("top.lang", F.lit(wanted[0])).alias("dominant"), F.when((F.col("hit") == 1) | F.col("top").isNull(), "index").otherwise("register_only").alias("verdict"))


#: Headings of tables of contents, dot leaders and trailing page numbers. Fixed values.
CONTENTS = "índice|indice|sommario|sumario|contenidos?|tabla de contenidos?|table of contents|contents"
CONTENTS_HEADING = r"(?imu)^[\s\d.·|#*—-]{0,12}(%s)(?![A-Za-z0-9_])[^\n]{0,40}$" % CONTENTS
LEADER = r"(?m)(?:\.[ \t]?){4,}[ \t]*([0-9]{1,4})[ \t]*$"
TRAILING = r"(?:^|[ \t])([0-9]{1,4})[ \t]*$"


def rising_share(numbers: Column) -> Column:
    """Share of the numbers that are no less than the one before; 0 for fewer than two."""
    n = F.size(numbers)
    steps = F.zip_with(F.slice(numbers, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(numbers, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: (a >= b).cast("int"))
    return F.when(n < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0), lambda s, x: s + x) / (n - 1))


def contents_page(text: Column) -> Column:
    """Whether a page is a table of contents: four dot leaders or more with numbers; or a heading of contents in the first 300
    signs, eight lines or more, and numbers at the end of five lines and half of them at least. Four fifths of the numbers
    must not fall, and the last must be five or more."""
    t = F.coalesce(text, F.lit(""))

    def ordered(numbers: Column, least: Column) -> Column:
        return T.let(F.transform(numbers, lambda x: x.cast("int")), lambda ns: (F.size(ns) >= least) & (rising_share(ns) >= 0.8) & (F.coalesce(F.try_element_at(ns, F.lit(-1)), F.lit(0)) >= 5))

    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    ends = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, TRAILING, 1)), lambda x: x != "")
    headed = F.left(t, F.lit(300)).rlike(CONTENTS_HEADING) & (F.size(lines) >= 8) & ordered(ends, F.greatest(F.lit(5), F.floor(F.size(lines) / 2)))
    return ordered(F.regexp_extract_all(t, F.lit(LEADER), 1), F.lit(4)) | headed


def topic_vote(text: Column, topics: dict[str, tuple[str, ...]], least: int = 2, default: str = "general") -> Column:
    """The topic with most key-word hits, `default` under `least`; ties go to the topic named first."""
    folded = T.fold(F.coalesce(text, F.lit("")))
    votes = F.array(*[F.struct(F.regexp_count(folded, F.lit("|".join(words))).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("topic")) for i, (name, words) in enumerate(topics.items())])
    best = F.array_max(votes)
    return F.when(best["n"] >= least, best["topic"]).otherwise(default)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: Column | None = None) -> DataFrame:
    """(doc_id, canonical, n_copies) of every row: canonical is the least id with the same text (null texts: themselves)."""
    key = F.md5(F.col(text))
    g = docs.where(F.col(text).isNotNull()).groupBy(key.alias("_key")).agg(F.min(doc_id).alias("canonical"), F.count("*").alias("n_copies"))
    return docs.select(doc_id, key.alias("_key")).join(g, "_key", "left").select(doc_id, F.coalesce("canonical", doc_id).alias("canonical"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def keep_first(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ledger(docs: DataFrame, done: DataFrame, doc_id: str = "doc_id", text: str = "text", wanted: Column | None = None) -> DataFrame:
    """(doc_id, status): done before, empty, empty_after_language, scarce (under 300 signs), to_do."""
    j = docs.join(done.select(doc_id, F.lit(True).alias("_done")).distinct(), doc_id, "left")
    n = F.coalesce(F.length(F.btrim(text)), F.lit(0))
    status = F.when(F.col("_done"), "done").when(n == 0, "empty").when(~F.coalesce(wanted if wanted is not None else F.lit(True), F.lit(False)), "empty_after_language").when(n < 300, "scarce").otherwise("to_do")
    return j.select(doc_id, status.alias("status"))


def blocks(text: str) -> list[tuple[str, int, str]]:
    """(kind, level, content) of the blocks of a marked-up text: headings (# or underlined), tables, paragraphs."""
    out: list[tuple[str, int, str]] = []
    held: list[str] = []

    def close() -> None:
        if held:
            kind = "table" if all(line.lstrip().startswith("|") for line in held) else "paragraph"
            out.append((kind, 0, "\n".join(held)))
            held.clear()

    for line in text.split("\n"):
        mark = len(line) - len(line.lstrip("#"))
        if 0 < mark <= 6 and line[mark : mark + 1] == " ":
            close()
            out.append(("heading", mark, line[mark:].strip()))
        elif not line.strip():
            close()
        else:
            if held and held[-1].lstrip().startswith("|") != line.lstrip().startswith("|"):
                close()
            held.append(line)
    close()
    return out


def pack(items: list[tuple[str, int, str]], target: int, most: int, least: int) -> list[dict]:
    """Chunks of consecutive blocks: a heading begins one; a chunk closes when the next block would lift it over `target`; a
    longer block is cut at `most`; a chunk shorter than `least` joins the one before it under the same heading."""
    chunks: list[dict] = []
    path: list[tuple[int, str]] = []
    body: list[str] = []

    def close() -> None:
        if not body:
            return
        content, where = "\n\n".join(body), [t for _, t in path]
        body.clear()
        if len(content) < least and chunks and chunks[-1]["path"] == where and len(chunks[-1]["content"]) + len(content) + 2 <= most:
            chunks[-1]["content"] += "\n\n" + content
            return
        for i in range(0, len(content), most):
            chunks.append({"path": where, "content": content[i : i + most]})

    for kind, level, content in items:
        if kind == "heading":
            close()
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, content))
            continue
        if body and sum(map(len, body)) + 2 * len(body) + len(content) > target:
            close()
        body.append(content)
    close()
    return chunks


def chunk(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", target: int = 3000, most: int = 7000, least: int = 450) -> DataFrame:
    """(doc_id, chunk_index, section_path, content). Null and blank texts have no chunks; the content of a text's chunks together
    is its blocks but for headings, which are in section_path (joined by ' > ')."""
    ready = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, paths, contents = [], [], [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for n, c in enumerate(pack(blocks(t), target, most, least)):
                    ids.append(i)
                    at.append(n)
                    paths.append(" > ".join(c["path"]))
                    contents.append(c["content"])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(paths, pa.string()), pa.array(contents, pa.string())], names=["doc_id", "chunk_index", "section_path", "content"])

    return ready.mapInArrow(run, "doc_id long, chunk_index int, section_path string, content string")


def numeric_claims(docs: DataFrame, units: tuple[str, ...], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, low, high, unit): clauses (parts between full stops, semicolons and line ends) with exactly one value, or one
    range a-b, and a unit; ambiguous clauses give nothing."""
    clause = F.explode(F.split(T.unify_signs(F.col(text)), r"[;\n]|\.(?![0-9])")).alias("clause")
    pattern = r"([0-9]+(?:\.[0-9]+)?)(?:\s*(?:-|to)\s*([0-9]+(?:\.[0-9]+)?))?\s*(%s)(?![A-Za-z0-9])" % "|".join(units)
    c = docs.select(doc_id, clause).where(F.regexp_count("clause", F.lit("[0-9]+(?:[.][0-9]+)?")) <= 2)
    one = c.where(F.regexp_count("clause", F.lit(pattern)) == 1)
    low = F.regexp_extract("clause", pattern, 1).try_cast("double")
    high = F.coalesce(F.nullif(F.regexp_extract("clause", pattern, 2), F.lit("")).try_cast("double"), low)
    found = one.select(doc_id, low.alias("low"), high.alias("high"), F.regexp_extract("clause", pattern, 3).alias("unit"), F.regexp_count("clause", F.lit("[0-9]+(?:[.][0-9]+)?")).alias("n"))
    return found.where((F.col("n") == 1) | (F.col("low") < F.col("high"))).select(doc_id, "low", "high", "unit")


def chunk_languages(chunks: DataFrame, group: str, position: str, lang: str, dropped: list[str], unknown: str = "unknown") -> DataFrame:
    """(group, position, lang, chunk): chunks of dropped languages go, unknown ones take the group's commonest known language
    (ties by name; dropped ones count), and the rest are numbered anew from 0."""
    n = chunks.where(F.col(lang) != unknown).groupBy(group, lang).agg(F.count("*").alias("n"))
    top = n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("c"), F.col(lang).alias("l"))).alias("top")).select(group, F.col("top.l").alias("_dominant"))
    kept = chunks.where(~F.col(lang).isin(*dropped)).join(top, group, "left")
    place = F.row_number().over(Window.partitionBy(group).orderBy(position)) - 1
    return kept.select(group, position, F.when(F.col(lang) == unknown, F.col("_dominant")).otherwise(F.col(lang)).alias("lang"), place.alias("chunk"))


def with_predecessor(rows: DataFrame, group: str, position: str, size: Column, name: Column) -> DataFrame:
    """rows with `span` and `heading`: size and name of the row before in the group."""
    w = Window.partitionBy(group).orderBy(position)
    return rows.withColumns({"span": F.lag(size).over(w), "heading": F.lag(name).over(w)})
