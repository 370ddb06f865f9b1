"""Text expressions: folding, tokens, windows, redaction. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain forms. Fixed values.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Function words that no lexical score counts. Fixed values.
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "los", "las", "una", "del", "por", "con", "para", "les", "des", "der", "die", "das", "und")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column, shortest: int = 3) -> Column:
    """Runs of ASCII letters and digits of the folded text, of `shortest` signs or more, without stop words. Null: empty."""
    found = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{%d,}" % shortest), 0)
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def words(text: Column) -> Column:
    """White-space words. Null: empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def shingle_hashes(items: Column, n: int) -> Column:
    """64-bit hashes of the runs of n items, repeats too; fewer items than n are one run. No string is built for a run."""
    return let(items, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(n)))))


def heading(text: Column) -> Column:
    """The first line."""
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def body(text: Column) -> Column:
    """What follows the first line."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.instr(t, "\n") > 0, F.substring(t, F.instr(t, "\n") + 1, F.length(t))).otherwise("")


def strip_markup(html: Column) -> Column:
    """Text of an HTML page: without scripts, styles, comments and tags; a block's end is a line end."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"</(p|div|h1|h2|h3|li|tr|title|article)>|<br>", "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", ""), r"\n+", "\n"), F.lit("\n "))


def redact(text: Column) -> Column:
    """Addresses, web links and long digit runs give way to marks."""
    t = F.regexp_replace(text, r"https?://[^\s]+", "<url>")
    t = F.regexp_replace(t, r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "<mail>")
    return F.regexp_replace(t, r"[0-9]{7,}", "<digits>")


def unify_signs(text: Column) -> Column:
    """Dashes, degree and micro signs, and gaps within numbers, as they come out of recognised scans."""
    t = F.translate(F.coalesce(text, F.lit("")), "–—−ºµ", "---°u")
    return F.regexp_replace(t, r"([0-9]) ([0-9]{3})\b", "$1$2")


def is_question(text: Column) -> Column:
    """Ends with a question mark, closing signs aside."""
    return F.coalesce(F.rtrim(text).rlike(r"\?[\"')\]»]*$"), F.lit(False))


def struck_out(text: Column) -> Column:
    """Without ~~struck~~ parts, line by line."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"~~[^~\n]*~~", "")
