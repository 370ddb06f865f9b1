"""Predicates of search and of the corpus policy, as column expressions, and the few that need a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def servable(status: Column, parent: Column, surrogates: bool = False) -> Column:
    """Rows that a search may return: live ones (no status counts as live), and surrogates (rows with a parent) only on demand."""
    live = F.coalesce(status, F.lit("active")) == "active"
    return live if surrogates else live & parent.isNull()


def differs(a: Column, b: Column) -> Column:
    """a and b are different; null is a value."""
    return ~a.eqNullSafe(b)


def policy_class(register_only: Column, other_language: Column, duplicate_of: Column) -> Column:
    """The first class that holds."""
    no = F.lit(False)
    return F.when(F.coalesce(register_only, no), "register_only").when(F.coalesce(other_language, no), "unsupported_language").when(duplicate_of.isNotNull(), "duplicate").otherwise("eligible")


def in_scope(source: Column, sources: list[str], model: Column, models: list[str]) -> Column:
    """The source or the model is allowed; with neither list all are."""
    if not sources and not models:
        return F.lit(True)
    return F.coalesce(source.isin(*sources), F.lit(False)) | F.coalesce(model.isin(*models), F.lit(False))


def has_token(scope: Column, key: str, separator: str = " ") -> Column:
    """The scope has the key as a whole token, not as a part of one."""
    return F.coalesce(F.array_contains(F.split(F.lower(scope), separator), key.lower()), F.lit(False))


def has_number(text: Column, number: str) -> Column:
    """The number stands in the text, not within a longer one."""
    return F.coalesce(text.rlike(f"(^|[^0-9]){number}([^0-9]|$)"), F.lit(False))


def has_code(text: Column, code: str) -> Column:
    """The code stands in the text as a word, whatever its case."""
    return F.coalesce(F.lower(text).rlike(f"(^|[^a-z0-9]){code.lower()}([^a-z0-9]|$)"), F.lit(False))


def with_variants(words: Column, variants: dict[str, list[str]]) -> Column:
    """words with each umbrella name replaced by its variants, the first of equals kept, in order."""
    known = F.create_map(*[x for k, v in variants.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(F.element_at(known, w), F.array(w)))))


def longest_members(words: Column, members: list[str]) -> Column:
    """Of a registry's members (runs of words) that stand in the words: at each place the longest, none within another."""
    size = {m: len(m.split(" ")) for m in members}
    by_length = sorted(members, key=lambda m: (-size[m], m))

    def at(i: Column) -> Column:
        found = F.when(F.lit(False), F.lit(""))
        for m in by_length:
            found = found.when(F.array_join(F.slice(words, i + 1, F.lit(size[m])), " ") == m, m)
        return found

    def step(s: Column, i: Column) -> Column:
        m = at(i)
        end = i + F.size(F.split(m, " "))
        return F.when((i >= s["end"]) & m.isNotNull(), F.struct(F.concat(s["out"], F.array(m)).alias("out"), end.cast("int").alias("end"))).otherwise(s)

    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("end"))
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), begin, lambda s, i: step(s, i.cast("int")))["out"]


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first rule (name, pattern) that the text matches."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(F.lit(default))


def facets(text: Column, rules: list[tuple[str, str]], multi: bool, most: int = 2) -> Column:
    """Names of the rules that a question matches, in their order: one, or `most` where several needs may be asked for."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in rules]))
    return F.slice(hits, 1, most if multi else 1)


def preferred_mode(rows: DataFrame, by: str, value: str, preferred: list[str]) -> DataFrame:
    """(by, value, n): the commonest preferred value of a group, else the commonest of all; ties by name. Null is no value."""
    n = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.min(F.struct((~F.col(value).isin(*preferred)).alias("o"), (-F.col("n")).alias("c"), F.col(value).alias("v"))).alias("top")).select(by, F.col("top.v").alias(value), (-F.col("top.c")).alias("n"))
