"""Mentions, the text index and what else round 3 adds, against plain versions."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.operators import copies, mentions


def by_regex(models, text):
    """One alternation of all models, the longest first."""
    gap = r"[-\s/.+]*"
    cores = {gap.join(re.findall("[a-z]+|[0-9]+", m)) for m in models} - {""}
    names = {re.sub(r"[-\s/]+", "", m): m for m in sorted(models, reverse=True)}
    if not cores:
        return []
    pattern = re.compile(r"\b(" + "|".join(sorted(cores, key=lambda c: (-len(c), c))) + r")(?!\d)", re.ASCII)
    return [(m.start(1), m.end(1), names[k]) for m in pattern.finditer(text) if (k := re.sub(r"[-\s/]+", "", m[1])) in names]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab1- /", min_size=1, max_size=5), min_size=1, max_size=8), st.text(alphabet="aab11 -./,_\n", max_size=40))
def test_automaton_finds_what_the_alternation_finds(models, text):
    auto = mentions.Automaton([(m, m) for m in sorted(models, reverse=True)])
    assert [(a, z) for a, z, _ in mentions.settle(auto.hits(text))] == [(a, z) for a, z, _ in by_regex(models, text)]


def test_mentions_of_models(spark):
    catalogue = spark.createDataFrame([("MS-5210UD",), ("CAD-150-8",), ("Léon 7",), (None,), ("--",)], "model string")
    rows = [(1, "the ms 5210 ud and ms5210ud, MS-5210/UDX"), (2, "cad 150 CAD-150-8 cad1508 cad-15 xcad-150 cad-1500"), (3, "LÉON7 leon-7 ßleon7 leon_7"), (4, None), (5, ""), (5, "cad-150")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("body", "hits", "mentions", "key", "model")})
    for block in (1, 2, 100):
        got = mentions.find(docs, catalogue, "model", block=block)
        assert set(got.columns) == set(docs.columns)
        by = {(r.doc_id, r.text): [m.model for m in r.mentions] for r in got.collect()}
        assert by[rows[0]] == ["MS-5210UD"] * 3
        assert by[rows[1]] == ["CAD-150", "CAD-150-8", "CAD-150-8"]
        assert by[rows[2]] == ["Léon 7"] * 2 and by[rows[3]] == by[rows[4]] == [] and by[rows[5]] == ["CAD-150"]
    assert [r.mentions for r in mentions.find(docs, catalogue.limit(0), "model").collect()] == [[]] * 6


def test_hundred_thousand_models():
    rng = np.random.default_rng(0)
    models = sorted({f"{''.join(rng.choice(list('abcdefghij'), 4))}-{n}" for n in rng.integers(0, 10**6, 100_000)})
    auto = mentions.Automaton([(m, m) for m in models])
    text = " ".join(m.replace("-", " ") for m in models[::50]) + " word" * 100_000
    began = time.time()
    assert [m for *_, m in mentions.settle(auto.hits(text))] == models[::50]
    assert time.time() - began < 20


# stores and retention


@pytest.fixture
def store(spark, tmp_path):
    from quarrylight.sources.store import Store

    return Store(spark, f"file://{tmp_path}/store")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_store_shows_all_tables_or_none(spark, store):
    from quarrylight.sources.store import Conflict

    a = lambda x: spark.createDataFrame([(x,)], "v int")
    assert store.generation() == 0 and store.commit({"a": a(1), "b": a(1)}) == 1
    staged = store.stage({"a": a(2), "b": a(2)})
    assert rows_of(store.read("a")) == [(1,)] and rows_of(store.staged(staged, "a")) == [(2,)]
    with pytest.raises(Exception, match="late"):  # the second of two tables fails
        store.stage({"a": a(3), "b": a(3).select(F.raise_error(F.lit("late")).cast("int").alias("v"))})
    assert store.generation() == 1 and rows_of(store.read("b")) == [(1,)]
    other = store.stage({"b": a(9)})
    assert store.publish(staged) == 2
    with pytest.raises(Conflict):
        store.publish(other)
    store.discard(other)
    assert (rows_of(store.read("a")), rows_of(store.read("b")), rows_of(store.read("b", 1))) == ([(2,)], [(2,)], [(1,)])
    assert store.commit({}, append={"a": a(5)}) == 3 and rows_of(store.read("a")) == [(2,), (5,)]
    assert len(store.sweep()) >= 2 and rows_of(store.read("a")) == [(2,), (5,)] and rows_of(store.read("b")) == [(2,)]


def test_retention_is_one_generation(spark, store):
    import hashlib
    import hmac

    from quarrylight.operators import retention

    key = b"k" * 80
    logs = spark.createDataFrame([(1, 10, "2020-01-01"), (2, 10, "2024-01-01"), (3, 11, "2020-01-01"), (4, None, "2020-01-01"), (5, 12, None)], "id int, person long, at string")
    votes = spark.createDataFrame([(1, 11, "2020-02-01"), (2, 13, "2020-02-01")], "id int, person long, at string")
    links = spark.createDataFrame([(1, "2020-01-01"), (2, "2024-01-01"), (3, None)], "id int, at string")
    people = spark.createDataFrame([(10, "p10"), (11, "p11"), (12, "p12"), (13, "p13"), (14, "p14")], "person long, code string")
    feedback = spark.createDataFrame([(14,)], "who long")
    store.commit({"logs": logs, "votes": votes, "links": links, "people": people, "feedback": feedback})
    rules = retention.Rules(key, {"logs": "at", "votes": "at"}, {"links": "at"}, "people", named=[("feedback", "who")])
    staged = retention.stage(store, rules, "2022-01-01", "manual")
    assert store.generation() == 1 and store.read("people").count() == 5  # nothing is seen before the end
    assert store.publish(staged) == 2
    code = lambda p: hmac.new(key, str(p).encode(), hashlib.sha256).hexdigest()
    assert {(r.id, r.person, r.pseudonym) for r in store.read("logs").collect()} == {(1, None, code(10)), (2, 10, None), (3, None, code(11)), (4, None, None), (5, 12, None)}
    assert rows_of(store.read("links").select("id")) == [(2,), (3,)] and rows_of(store.read("people").select("person")) == [(10,), (12,), (14,)]
    assert rows_of(store.read("receipts").select("table", "mode", "touched")) == [("links", "deleted", 1), ("logs", "pseudonym", 2), ("people", "mapping", 2), ("votes", "pseudonym", 2)]
    store.publish(retention.stage(store, rules, "2022-01-01", "cron"))  # a second pass finds nothing, and keeps the pseudonyms
    assert store.read("logs").where("pseudonym is not null").count() == 2 and rows_of(store.read("receipts").where("origin = 'cron'").select("touched").distinct()) == [(0,)]


# the stored text index


def test_index_after_updates_equals_a_rebuild(spark, store):
    from quarrylight.functions import text as T
    from quarrylight.operators import lexical
    from quarrylight.operators.textindex import TextIndex
    from quarrylight.sources.store import Store

    rng = np.random.default_rng(3)
    names = ["alpha", "beta", "gamma", "delta", "the", "of", "omega", "sigma"]
    text = lambda: "\n".join(" ".join(rng.choice(names, int(rng.integers(0, 9)))) for _ in range(3))
    first = [(i, text()) for i in range(60)]
    changed = [(i, text()) for i in (3, 5, 59, 60, 61)] + [(7, None)]
    gone = [2, 5, 60]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    fields = {"title": T.heading(F.col("text")), "body": T.body(F.col("text"))}
    index = TextIndex(store, {"title": 1.0, "body": 0.4})
    index.build(frame(first), fields)
    index.update(frame(changed), fields)
    index.update(frame([]), fields, removed=frame([(i, "") for i in gone]).select("doc_id"))
    final = {**dict(first), **dict(changed)}
    final = [(i, t) for i, t in final.items() if i not in gone]
    fresh_index = TextIndex(Store(spark, store.folder + "-2"), {"title": 1.0, "body": 0.4})
    fresh_index.build(frame(final), fields)
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma the delta"), (3, "zeta"), (4, None), (None, "alpha"), (5, "beta beta")], "item_id long, text string")

    def answers(x):
        return [rows_of(x.match(queries, how)) for how in ("or", "and", "phrase")] + [rows_of(x.bm25(queries, {"title": 3, "body": 1}).na.fill(0)), rows_of(x.report(queries, k=3).na.fill(-1))]

    want = answers(fresh_index)
    assert answers(index) == want
    assert index.compact() == 4 and len(store.manifest()["tables"]["postings"]) == 1 and answers(index) == want
    words_of = lambda t: [re.findall("[a-z0-9]+", part) for part in ((t or "").split("\n", 1) + [""])[:2]]
    phrase = [("alpha", 0), ("beta", 1)]
    assert [d for q, d, *_ in want[2] if q == 1] == sorted(i for i, t in final if any(all(at + o < len(w) and w[at + o] == p for p, o in phrase) for w in words_of(t) for at in range(len(w))))
    gap = sorted(i for i, t in final if any(w[at] == "gamma" and at + 2 < len(w) and w[at + 2] == "delta" for w in words_of(t) for at in range(len(w))))
    assert [d for q, d, *_ in want[2] if q == 2] == gap  # the stop word between keeps its place
    plain = lexical.bm25(frame(final), queries, T.tokens(T.body(F.col("text"))), T.tokens(F.col("text")), title_tokens=T.tokens(T.heading(F.col("text"))))
    assert rows_of(plain.select("item_id", "doc_id", "rank")) == rows_of(fresh_index.bm25(queries, {"title": 3, "body": 1}).select("item_id", "doc_id", "rank"))
    with pytest.raises(ValueError, match="repeated"):
        index.update(frame([(1, "a"), (1, "b")]), fields)
    assert store.generation() == 4


# section paths


@pytest.mark.parametrize("runs", [1, 4, 13])
def test_section_paths_are_those_of_one_stack(spark, runs):
    from quarrylight.operators import sections

    rng = np.random.default_rng(runs)
    rows = []
    for host, n in (("a", 300), ("b", 1), ("c", 40), (None, 5)):
        for i in range(n):
            level = [None, None, None, 1, 2, 3, 3, 6, 9][int(rng.integers(9))] if i % 50 < 30 else None
            rows.append((host, i // 7, i % 7, level, f"t{i}", 1))
    blocks = spark.createDataFrame(rows, "host string, page int, block int, level int, title string, path int").withColumns({c: F.lit(0) for c in ("run", "at", "last0", "seen", "carried1")})
    want, stacks = {}, {}
    for host, page, block, level, title, _ in rows:
        stack = stacks.setdefault(host, [])
        if level and level <= 6:
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
        want[host, page, block] = [t for _, t in stack]
    got = sections.section_paths(blocks.repartition(5), "host", ["page", "block"], "level", "title", runs=runs)
    assert set(got.columns) == {*blocks.columns, "anchors"}
    assert {(r.host, r.page, r.block): r.path for r in got.collect()} == want


# near copies


@pytest.mark.parametrize("hashed", [copies.md5_number, copies.crc])
def test_sketch_is_sorted_by_spark(spark, hashed):
    texts = ["one two three four", "", None, "É  a b\tc d", " ".join(f"w{i % 40}" for i in range(90)), "a b c d e " * 4]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size in (3, 256):
        column = copies.sketch(F.col("t"), size, 5, hashed)
        got = {r.i: r.s for r in rows.select("i", column.alias("s")).collect()}
        for i, t in enumerate(texts):
            w = (t or "").lower().replace("é", "e").split()
            each = [" ".join(w[j : j + 5]).encode() for j in range(len(w) - 4)]
            assert got[i] == sorted({int(hashlib.md5(x).hexdigest()[:8], 16) if hashed is copies.md5_number else zlib.crc32(x) for x in each})[:size]
        plan = rows.select(column.alias("s"))._jdf.queryExecution().analyzed().toString()
        assert "sort_array" in plan and "array_sort" not in plan  # array_sort compares by an expression
    pair = rows.select(copies.likeness(F.array(F.lit(1), F.lit(2), F.lit(4)), F.array(F.lit(2), F.lit(3), F.lit(4)), 3).alias("x"))
    assert pair.first().x == 1 / 3 and "array_sort" not in pair._jdf.queryExecution().analyzed().toString()


def test_near_copies_against_all_pairs(spark):
    from quarrylight.operators import copies

    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(names, 60)) for _ in range(6)]
    texts = []
    for i in range(120):
        words = list(base[i % 6])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(60))] = "x" + str(rng.integers(1000))
        texts.append(" ".join(words))
    texts += [texts[0], None, "", "one two three", "one two three", *(" ".join(["stop"] * 50 + list(rng.choice(names, 30))) for _ in range(5))]
    rows = list(enumerate(texts)) + [(None, texts[1]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("s", "h", "k", "n", "same", "rep", "family")}).repartition(5)
    for size in (16, 256):
        ids = {i: sorted({zlib_crc(" ".join(w[j : j + 5])) for j in range(len(w) - 4)})[:size] for i, t in enumerate(texts) for w in [(t or "").split()]}
        root = {i: i for i in ids}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a in ids:
            for b in ids:
                if a < b and ids[a] and ids[b]:
                    union = sorted({*ids[a], *ids[b]})[:size]
                    if len({*union} & {*ids[a]} & {*ids[b]}) / len(union) >= 0.8:
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
        got = {r.doc_id: r.family for r in copies.near_copies(docs, size=size).collect()}
        assert got == {i: find(i) for i in ids}
    assert copies.near_copies(docs.limit(0)).count() == 0


def zlib_crc(x):
    import zlib

    return zlib.crc32(x.encode())


# what was wrong in round 2


def test_lineage_ends_on_circles(spark):
    from quarrylight.operators import identity

    links = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 4), (5, 6), (5, 7), (7, 6), (None, 1), (8, None)], "source int, target int")
    got = sorted(tuple(r) for r in identity.lineage(links).collect())
    assert got == [(1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1), (5, 6, 1), (5, 7, 1), (7, 6, 1)]
    chain = spark.range(1, 21).select(F.col("id").alias("source"), (F.col("id") - 1).alias("target"))
    assert identity.lineage(chain).agg(F.max("depth")).first()[0] == 20  # no depth is cut off
    assert identity.lineage(chain, depth=3).agg(F.max("depth")).first()[0] == 3
    ends = {r.source: (r.target, r.steps) for r in identity.follow(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 5), (5, 6), (6, 7), (9, 9)], "source int, target int")).collect()}
    assert ends == {1: (None, None), 2: (None, None), 3: (None, None), 4: (7, 3), 5: (7, 2), 6: (7, 1), 9: (None, None)}


def test_contents_pages(spark):
    from quarrylight.operators import corpus

    lines = lambda ns, dots="": "\n".join(f"Chapter {chr(65 + i)} {dots} {n}" for i, n in enumerate(ns))
    cases = {lines([1, 3, 5, 9], "....."): True, lines([1, 3, 5], "....."): False, lines([9, 7, 5, 1], "....."): False, lines([1, 2, 3, 4], "....."): False, "Índice\n" + lines(range(1, 9)): True, "Sommario\n" + lines(range(1, 4)): False, "Contention\n" + lines(range(1, 9)): False, lines(range(1, 9)): False, "": False}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(corpus.contents_page(F.col("t"))).collect()] == list(cases.values())
    assert spark.sql("select cast(null as string) t").select(corpus.contents_page(F.col("t"))).first()[0] is False


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400))
def test_unit_spans_cover_the_text(text):
    from quarrylight.operators.passages import unit_spans

    spans = unit_spans(text, 40, 10)
    assert spans == sorted(set(spans)) and all(0 <= a < z <= len(text) and z - a <= 40 and text[a:z].strip() for a, z in spans)
    covered = {i for a, z in spans for i in range(a, z)}
    assert all(i in covered for i, c in enumerate(text) if c not in " \n")


def test_unlabelled_rows_are_kept(spark):
    from quarrylight.operators import fusion

    rows = spark.createDataFrame([(1, "es", "a"), (2, "fr", "a"), (3, None, "a"), (4, "pt", "b"), (5, "fr", "b"), (6, "fr", None)], "id int, language string, by string").withColumns({"n": F.lit(1), "group": F.lit(2)})
    got = fusion.filter_open(rows, F.col("language").isin("es", "en"), "by", unlabelled=F.col("language").isNull())
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5, 6] and set(got.columns) == set(rows.columns)


def test_citations_and_prefix(spark):
    from quarrylight.operators import serving

    chunks = spark.createDataFrame([(1, 1, "A.pdf"), (1, 2, "B (2).pdf"), (2, 1, "A.pdf"), (2, 2, None), (3, 1, "zzz.pdf")], "answer_id int, number long, source_file string")
    answers = spark.createDataFrame([(1, "x [F2] yy [F1][F2] [F7]"), (2, "see a, [F9]"), (3, "nothing"), (4, None)], "answer_id int, answer string")
    assert rows_of(serving.cited(answers, chunks)) == [(1, 1, 1, 10), (1, 2, 2, 2), (2, 1, 1, 4)]
    row = lambda xs: spark.createDataFrame(xs, "query int, place int, id int, row string")
    base = [(q, p, p, f"r{p}") for q in range(1, 7) for p in (1, 2)]
    served = [(1, 1, 1, "r1"), (1, 2, 2, "r2"), (1, 3, 9, "n"), (2, 1, 1, "r1"), (3, 1, 1, "r1"), (3, 2, 2, "other"), (4, 1, 1, "r1"), (4, 2, 2, "r2"), (4, 3, 1, "r1"), *[(5, p, p, f"r{p}") for p in range(1, 8)], (6, 1, 1, "r1"), (6, 2, 2, "r2"), (6, 3, None, "n")]
    verdicts, lists = serving.protected(row(base), row(served))
    assert {r.query: r.verdict for r in verdicts.collect()} == {1: "ok", 2: "removed", 3: "changed", 4: "repeated", 5: "overflow", 6: "repeated"}
    assert rows_of(lists.where("query in (1, 2)")) == [(1, 1, 1), (1, 2, 2), (1, 3, 9), (2, 1, 1), (2, 2, 2)]


@pytest.mark.parametrize("name", ["source_legends", "protected_prefix"])
def test_without_broadcast_joins(spark, sf_dir, name):
    """As on tables too large to be broadcast."""
    import oracle

    import __spark_entry__ as driver

    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert oracle.differences(driver.queries()[name](spark, sf_dir), oracle.connect(sf_dir), driver.oracle_sql()[name]) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_postings_in_pieces(monkeypatch):
    """Rows of a batch are made for a bounded number of words at once, and are the same however it is cut."""
    import pyarrow as pa

    from quarrylight.operators import textindex

    rng = np.random.default_rng(9)
    texts = [[f"word{x}" for x in rng.integers(0, 9, int(n))] for n in (0, 3, 40, 1, 0, 25, 7)]
    batch = pa.record_batch([pa.array(range(7)), pa.array(texts, pa.list_(pa.string())), pa.array([t[:2] for t in texts], pa.list_(pa.string()))], names=["doc_id", "f0", "f1"])
    made = lambda: [b.to_pylist() for b in textindex._postings(2, 3)(iter([batch.slice(1), batch.slice(0, 0)]))]
    whole = sorted(str(r) for b in made() for r in b)
    for words in (1, 10, 30):
        monkeypatch.setattr(textindex, "WORDS", words)
        pieces = made()
        assert sorted(str(r) for b in pieces for r in b) == whole and len(pieces) > 4
