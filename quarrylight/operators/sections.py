"""Section paths over long sequences of blocks: the stack of headings, which goes on from page to page.

A heading of level n closes every open heading of level n or deeper and opens itself; the other blocks leave the stack as it is.
What a run of blocks does to the stack is told by one number for each level: the place of its last heading of that level. Two
runs combine by the larger places, and the stack holds the last heading of a level if no last heading of a higher level stands
behind it. This combination is associative, so the sequence is cut into runs anywhere: each task takes the headings of its
run, one row for each run carries them on, and no group, however long, is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import fresh, written

LEVELS = 6


def section_paths(blocks: DataFrame, group: str, position: list[str], level: str, title: str, runs: int | None = None) -> DataFrame:
    """blocks with `path` (titles of the open headings, the highest first, a heading's own included) and `anchors` (their
    places as structs of `position`).

    level: 1 to LEVELS for headings, null for other blocks; other numbers count as null. position: columns that order a
    group's blocks; equal positions are one place, whose heading is the one of the least level and title. Null groups are
    a group. runs: into how many runs all blocks are cut; by default as many as there are shuffle partitions. Columns of those
    names are replaced."""
    kept = [c for c in blocks.columns if c.lower() not in ("path", "anchors")]
    run, of_run, at, seen, stack = (fresh(x, blocks) for x in ("run", "of_run", "at", "seen", "stack"))
    last, carried = ([fresh(f"{x}{n}", blocks) for n in range(LEVELS)] for x in ("last", "carried"))
    rows = blocks.select(*kept)
    spread = (runs, group, *position) if runs else (group, *position)
    rows = written(rows.repartitionByRange(*spread).sortWithinPartitions(group, *position).withColumn(run, F.spark_partition_id()), "runs")  # written, so that the runs stay as they were cut

    place = F.struct(*position)
    depth = F.when(F.col(level).between(1, LEVELS), F.col(level))
    heading = [F.when(depth == n, F.struct(place.alias(at), F.col(title).alias("title"))) for n in range(1, LEVELS + 1)]

    # the last heading of each level in each run of a group, and of all runs before it
    ends = rows.groupBy(run, group).agg(*[F.max(h).alias(last[n]) for n, h in enumerate(heading)])
    before = Window.partitionBy(group).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)  # a row for each run, not block
    carry = ends.select(F.col(run).alias(of_run), F.col(group).alias(seen), *[F.max(last[n]).over(before).alias(carried[n]) for n in range(LEVELS)])
    within = Window.partitionBy(run, group).orderBy(*position)  # the blocks of one run
    here = rows.select("*", *[F.max(h).over(within).alias(last[n]) for n, h in enumerate(heading)])
    both = here.join(carry, (F.col(run) == F.col(of_run)) & F.col(group).eqNullSafe(F.col(seen)))
    newest = [F.coalesce(F.col(last[n]), F.col(carried[n])) for n in range(LEVELS)]
    return both.select(*kept, open_headings(newest, at).alias(stack)).select(*kept, F.transform(stack, lambda h: h["title"]).alias("path"), F.transform(stack, lambda h: h[at]).alias("anchors"))


def open_headings(newest: list[Column], at: str) -> Column:
    """The stack as an array, from the last heading of each level (null: none). A heading is open if it stands behind the last
    heading of every higher level."""
    out = []
    for n, h in enumerate(newest):
        above = [F.coalesce(h[at] > o[at], F.lit(True)) for o in newest[:n]]
        is_open = h.isNotNull()
        for a in above:
            is_open = is_open & a
        out.append(F.when(is_open, h))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


#: A heading, paragraph or list item of a page with the inline marks in it.
BLOCK = "<(?:h[1-6]|p|li)[ >](?:[^<]+|</?(?:b|i|em|strong|a|br|span|code)[ >/])*"


def html_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, a row for each block (block, level, title) in order: headings with their level, paragraphs and list
    items with a null level; title is the block's text."""
    rest = [c for c in pages.columns if c != html and c.lower() not in ("block", "level", "title")]
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(BLOCK), 0)
    each = pages.select(*rest, F.posexplode(found).alias("block", "title"))
    plain = F.btrim(F.regexp_replace(F.regexp_replace("title", "<[^>]*>", " "), "[ \\n]+", " "), F.lit(" "))
    level = F.nullif(F.regexp_extract("title", "^<h([1-6])", 1), F.lit("")).cast("int")
    return each.select(*rest, "block", level.alias("level"), plain.alias("title"))
