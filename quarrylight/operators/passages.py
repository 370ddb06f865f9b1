"""Passages of texts: exact windows, evidence units, the best window for a question, page windows, previews."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T

#: How far behind a window's overlap the beginning of a line is looked for. Fixed value.
NEAR = 160


def windows(rows: DataFrame, row_id: str, text: str, size: int, stride: int) -> DataFrame:
    """(row_id, start, end, quote): windows of `size` signs at every `stride`, the last one shorter; an empty text has none.
    Offsets count code points from 0."""
    n = F.length(text)
    last = F.greatest(F.ceil((n - size) / F.lit(float(stride))), F.lit(0)).cast("int")
    t = rows.where(n > 0).select(row_id, text, F.explode(F.sequence(F.lit(0), last)).alias("i"))
    start = (F.col("i") * stride).cast("int")
    return t.select(row_id, start.alias("start"), F.least(start + size, F.length(text)).cast("int").alias("end"), F.substring(text, start + 1, F.lit(size)).alias("quote"))


def line_spans(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, start, end, quote) of the lines that are not blank. row_id: unique."""
    lines = rows.select(row_id, F.posexplode(F.split(text, "\n", -1)).alias("pos", "quote"))
    before = Window.partitionBy(row_id).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("quote") + 1).over(before), F.lit(0)).cast("int")
    return lines.withColumn("start", start).select(row_id, "start", (F.col("start") + F.length("quote")).alias("end"), "quote").where(F.trim("quote") != "")


def exact_windows(rows: DataFrame, row_id: str, text: str, size: int = 360, stride: int = 180) -> DataFrame:
    """Lines of `size` signs or fewer and fixed windows, equal spans once."""
    lines = line_spans(rows, row_id, text).where(F.col("end") - F.col("start") <= size)
    return lines.union(windows(rows, row_id, text, size, stride)).dropDuplicates([row_id, "start", "end"])


def unit_spans(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of evidence in a text, in order. Windows of `most` signs end behind the last line end or full stop of their second
    half, and the next one begins `overlap` before that, at a line's beginning if one is near. Paragraphs of half a window or
    less are spans too, and so are such lines of paragraphs longer than a window."""
    out, start, n = set(), 0, len(text)
    while start < n:
        end = min(n, start + most)
        if end < n:
            stops = [(text.rfind(mark, start + most // 2, end), len(mark)) for mark in ("\n", ". ")]
            at, size = max(stops)
            end = at + size if at > start else end
        if text[start:end].strip():
            out.add((start, end))
        if end >= n:
            break
        start = max(start + 1, end - overlap)
        line = text.find("\n", start, min(n, start + NEAR))
        start = line + 1 if line >= 0 else start
    begun = 0
    for gap in [*re.finditer(r"\n\s*\n", text), None]:
        end = gap.start() if gap else n - text.endswith("\n")
        if text[begun:end].strip():
            if end - begun <= most // 2:
                out.add((begun, end))
            elif end - begun > most:
                at = begun
                for line in re.findall(r"[^\n]*\n|[^\n]+", text[begun:end]):
                    if line.strip() and len(line) <= most // 2:
                        out.add((at, at + len(line)))
                    at += len(line)
            begun = gap.end() if gap else n
        elif gap and text[:begun].strip():
            begun = gap.end()
    return sorted(out)


def evidence_units(rows: DataFrame, row_id: str, text: str, size: int = 1200, overlap: int = 300, fragment: int = 1) -> DataFrame:
    """(row_id, start, end, unit_id): spans of evidence with ids that commit to the fragment, place and content. Null and blank
    texts have none."""
    if size < 400 or not 0 <= overlap < size // 2:
        raise ValueError("a window has 400 signs or more and overlaps by less than its half")
    ready = rows.select(F.col(row_id).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": z} for a, z in unit_spans(t, size, overlap)] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("row"), batch.column("text"), pa.array(spans, kind)], names=["row", "text", "spans"])

    found = ready.mapInArrow(run, ready.withColumn("spans", F.array().cast("array<struct<start: int, end: int>>")).schema)
    each = found.select("row", "text", F.posexplode("spans").alias("i", "s")).select("row", "i", "s.start", "s.end", F.sha2(F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), 256).alias("digest"))
    identity = F.sha2(F.concat_ws(":", F.lit(fragment), F.col("row").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), "digest"), 256)
    return each.select(F.col("row").alias(row_id), "start", "end", F.concat(F.lit("E"), F.format_string("%03d", F.col("i") + 1), F.lit("_"), F.left(identity, F.lit(10))).alias("unit_id"))


def best_window(rows: DataFrame, row_id: str, text: str, terms: str, size: int = 800, stride: int = 400) -> DataFrame:
    """(row_id, start, end, n_hits): the window with the most of the row's terms (array); ties to the first, then the shortest."""
    w = windows(rows, row_id, text, size, stride).join(rows.select(row_id, terms), row_id)
    hits = F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("quote"))), terms))
    best = F.min(F.struct((-hits).alias("h"), "start", "end")).alias("b")
    return w.groupBy(row_id).agg(best).select(row_id, "b.start", "b.end", (-F.col("b.h")).alias("n_hits"))


def page_window(wanted: DataFrame, rows: DataFrame, group: str, page: str, order: list[str], cap: int = 6) -> DataFrame:
    """Rows of the wanted (group, page)s, exact pages first, then those one page off; `cap` for each group. Each wanted page is
    dealt to three, so the join is an equality."""
    near = wanted.select(group, F.explode(F.array(*[F.struct((F.col(page) + o).alias("p"), F.lit(abs(o)).alias("off")) for o in (0, -1, 1)])).alias("x"))
    near = near.groupBy(group, F.col("x.p").alias(page)).agg(F.min("x.off").alias("off"))
    w = Window.partitionBy(group).orderBy("off", page, *order)
    return rows.join(near, [group, page]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def preview(text: Column, needle: Column, head: int = 800, span: int = 200) -> Column:
    """The first signs, and, if the needle comes only later, the exact span from there on."""
    late = F.position(needle, F.substring(text, F.lit(head + 1), F.length(text)))
    return F.concat(F.left(text, F.lit(head)), F.when((F.position(needle, F.left(text, F.lit(head))) == 0) & (late > 0), F.concat(F.lit("\n...\n"), F.substring(text, late + head, F.lit(span)))).otherwise(""))


def distinctive(text: Column) -> Column:
    """Values that a text can be recognised by: words with a digit, lower case, each once, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]*[0-9][a-z0-9]*"), 0)))


def quote_overlap(quote: Column, content: Column) -> Column:
    """Share of a quote's distinct tokens that the content has."""
    q = F.array_distinct(quote)
    return F.try_divide(F.size(F.array_intersect(q, content)).cast("double"), F.size(q))


def batches(rows: DataFrame, by: str, order: str, text: str, most: int = 128, budget: int = 320_000) -> DataFrame:
    """(by, order, batch): consecutive rows of a group in batches of `most` rows and `budget` signs at most (a longer text stands
    alone). A task reads its sorted rows once and holds three numbers, not the group."""
    import pyarrow as pa

    t = rows.select(by, order, F.coalesce(F.length(text), F.lit(0)).cast("long").alias("size")).repartition(by).sortWithinPartitions(by, order)

    def run(frames):
        group, batch, n, used = object(), 0, 0, 0
        for f in frames:
            out = []
            for g, size in zip(f.column(0).to_pylist(), f.column(2).to_pylist(), strict=True):
                if g != group:
                    group, batch, n, used = g, 0, 0, 0
                elif n >= most or used + size > budget:
                    batch, n, used = batch + 1, 0, 0
                n, used = n + 1, used + size
                out.append(batch)
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(1), pa.array(out, pa.int32())], names=[by, order, "batch"])

    fields = t.drop("size").schema.add("batch", "integer")
    return t.mapInArrow(run, fields)
