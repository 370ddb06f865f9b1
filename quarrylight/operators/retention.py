"""Retention over several tables: old rows lose the person for a pseudonym, old links go, and so does the mapping of people whom
no row names any more. All of it, with its receipt, is one generation of a store."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.session import fresh
from quarrylight.sources.store import Staged, Store

#: Bytes of a block of SHA-256, and the two pads of a keyed hash. Fixed values.
HASH_BLOCK, INNER, OUTER = 64, 0x36, 0x5C


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in lowercase hex. Null stays null."""
    import hashlib

    whole = (hashlib.sha256(key).digest() if len(key) > HASH_BLOCK else key).ljust(HASH_BLOCK, b"\0")
    pad = lambda p: F.unhex(F.lit(bytes(b ^ p for b in whole).hex()))
    return F.sha2(F.concat(pad(OUTER), F.unhex(F.sha2(F.concat(pad(INNER), message.cast("string").cast("binary")), 256))), 256)


def pseudonymised(rows: DataFrame, old: Column, person: str, pseudonym: str, key: bytes) -> DataFrame:
    """rows with the person's id taken out of old rows and its pseudonym put in; pseudonyms given earlier stay."""
    past = F.coalesce(old, F.lit(False)) & F.col(person).isNotNull()
    columns = [F.col(c) for c in rows.columns if c not in (person, pseudonym)]
    before = F.col(pseudonym) if pseudonym in rows.columns else F.lit(None).cast("string")
    return rows.select(*columns, F.when(~past, F.col(person)).alias(person), F.when(past, hmac_sha256(key, F.col(person))).otherwise(before).alias(pseudonym))


@dataclass
class Rules:
    """What a pass touches: logs (table: time column) lose the person, links (table: time column) lose the row, and the mapping
    loses the people that no log and no other table (`named`: table, column) names."""

    key: bytes
    logs: dict[str, str]
    links: dict[str, str]
    mapping: str
    person: str = "person"
    pseudonym: str = "pseudonym"
    named: list[tuple[str, str]] = field(default_factory=list)


def _is_old(df: DataFrame, time: str, cutoff: str) -> Column:
    return F.col(time) < F.lit(cutoff).cast(df.schema[time].dataType)


def passed(tables: dict[str, DataFrame], rules: Rules, cutoff: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after the pass, receipt: table, mode, touched)."""
    after, counts = {}, []
    count = lambda df, name, mode, hit: df.agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("touched")).select(F.lit(name).alias("table"), F.lit(mode).alias("mode"), "touched")
    for name, time in rules.logs.items():
        df = tables[name]
        old = _is_old(df, time, cutoff)
        after[name] = pseudonymised(df, old, rules.person, rules.pseudonym, rules.key)
        counts.append(count(df, name, "pseudonym", old & F.col(rules.person).isNotNull()))
    for name, time in rules.links.items():
        old = _is_old(tables[name], time, cutoff)
        after[name] = tables[name].where(~F.coalesce(old, F.lit(False)))
        counts.append(count(tables[name], name, "deleted", old))
    still = [after.get(t, tables.get(t)).select(F.col(c).alias("who")) for t, c in [*((t, rules.person) for t in rules.logs), *rules.named]]
    people, mark = tables[rules.mapping], fresh("held", tables[rules.mapping])
    held = reduce(DataFrame.union, still).where("who is not null").distinct().select(F.col("who").alias(rules.person), F.lit(True).alias(mark))
    marked = people.join(held, rules.person, "left")
    after[rules.mapping] = marked.where(F.col(mark).isNotNull()).select(*people.columns)
    counts.append(count(marked, rules.mapping, "mapping", F.col(mark).isNull()))
    return after, reduce(DataFrame.union, counts)


def stage(store: Store, rules: Rules, cutoff: str, origin: str) -> Staged:
    """Writes a pass over a store's tables, the receipt's rows added to `receipts`; nothing is seen before `store.publish`."""
    names = {*rules.logs, *rules.links, rules.mapping, *(t for t, _ in rules.named)}
    after, receipt = passed({n: store.read(n) for n in names}, rules, cutoff)
    rows = receipt.select(F.lit(origin).alias("origin"), F.lit(cutoff).alias("cutoff"), "table", "mode", "touched")
    return store.stage(after, append={"receipts": rows}, receipt={"pass": "retention", "origin": origin, "cutoff": cutoff})
