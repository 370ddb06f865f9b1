import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions.vectors import cosine
from quarrylight.operators import corpus, evaluate, fusion, identity, passages, vector
from quarrylight.sources import files
from quarrylight.streaming import events as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_cosine_truth_table(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0]


def test_top_k_ties_nulls_and_threshold(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.vec_id, r["rank"]) for r in vector.top_k(v, q, 2, 0.5).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    assert vector.top_k(v.limit(0), q, 2, 0.5).count() == 0


def test_greedy_dedup_is_sequential(spark):
    def at(deg):
        return [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]

    v = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(15)), (3, "a", at(30)), (4, "b", at(0)), (5, None, at(0)), (6, "a", None)], "vec_id long, g string, embedding array<double>")
    # 2 is a copy of 1; 3 is near 2 only, which was not kept
    assert dict(rows(vector.greedy_dedup(v, "g", 0.94), "vec_id")) == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None}


def test_blocks_and_chunks(spark):
    text = "# A\nintro line\n\n## B\n| x | y |\n| 1 | 2 |\nafter\n\n" + "long " * 900 + "\n# C\nend"
    got = corpus.chunk(spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string"), target=3000, most=4000, least=450)
    out = rows(got, "chunk_index")
    assert [r[2] for r in out] == ["A", "A > B", "A > B", "A > B", "C"]
    assert out[1][3].startswith("| x | y |") and all(len(r[3]) <= 4000 for r in out)
    assert "".join(r[3] for r in out).replace("\n", "").count("long ") == 900 or "".join(r[3] for r in out).count("long") == 900


def test_claims(spark):
    d = spark.createDataFrame([(1, "Weight 12 kg; width 3–5 cm.\nBetween 4 and 6 kg and 7 kg. Mass 1 200 kg")], "doc_id long, text string")
    assert rows(corpus.numeric_claims(d, ("kg", "cm")), "unit", "low") == [(1, 3.0, 5.0, "cm"), (1, 12.0, 12.0, "kg"), (1, 1200.0, 1200.0, "kg")]


def test_contents_page(spark):
    good = "\n".join(f"Part {i} ..... {i * 3}" for i in range(1, 7))
    bad = "\n".join(f"Part {i} ..... {30 - i * 3}" for i in range(1, 7))
    df = spark.createDataFrame([(good,), (bad,), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(corpus.contents_page(F.col("t"))).collect()] == [True, False, False, False]


def test_page_guard(spark):
    long = "word " * 300
    df = spark.createDataFrame([(1, "<p>a b</p><p>c</p>"), (2, f"<div>{long}</div><p>x</p>"), (3, None), (4, "")], "page_id long, html string")
    assert [r[1] for r in rows(corpus.page_guard(df).select("page_id", "verdict"), "page_id")] == ["sound", "degenerate", "degenerate", "degenerate"]


def test_complement_is_greedy(spark):
    c = spark.createDataFrame([("q", 1, 1.0, ["a", "b"]), ("q", 2, 0.95, ["a", "b"]), ("q", 3, 0.9, ["c"])], "query string, id long, score double, terms array<string>")
    assert rows(fusion.complement(c), "place") == [("q", 1, 1), ("q", 3, 2)]


def test_fail_open(spark):
    d = spark.createDataFrame([(1, "a", "es"), (2, "a", None), (3, "b", "fr")], "id long, s string, lang string")
    assert [r[0] for r in rows(fusion.filter_open(d, F.col("lang") == "es", "s").select("id"), "id")] == [1, 3]


def test_follow_detects_circles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7)], "source long, target long")
    assert rows(identity.follow(links), "source") == [(1, 3, 2), (2, 3, 1), (7, None, None), (8, None, None)]


def test_majority_and_bootstrap(spark):
    v = spark.createDataFrame([("a", "ok")] * 2 + [("a", "bad")] * 2 + [("b", "ok")] * 2 + [("c", "ok")] * 3, "k string, v string")
    assert rows(evaluate.majority(v, "k", "v", ["bad", "ok"]), "k") == [("a", 4, "bad"), ("b", 2, "error"), ("c", 3, "ok")]
    x = np.random.default_rng(1).normal(5, 2, 400)
    b = evaluate.bootstrap_mean(spark.createDataFrame([("g", float(v), i) for i, v in enumerate(x)], "g string, v double, i long"), "g", "v", "i").collect()[0]
    half = 1.96 * x.std() / 20
    assert abs(b["low"] - (x.mean() - half)) < 0.08 and abs(b["high"] - (x.mean() + half)) < 0.08


def test_text_expressions(spark):
    df = spark.createDataFrame([("Über den ÉTÉ, 2024!",), (None,)], "t string")
    got = df.select(T.tokens(F.col("t")), T.words(F.col("t")), T.shingle_hashes(T.words(F.col("t")), 3), T.shingle_hashes(T.words(F.lit("x Über den ÉTÉ,")), 3)).collect()
    assert got[0][0] == ["uber", "den", "ete", "2024"] and got[0][1][0] == "Über" and len(set(got[0][2])) == 2 and got[0][2][0] == got[0][3][1]
    assert got[1][0] == [] and got[1][1] == []


def test_files(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"id": 1, "x": "a"}) + "\nnonsense\n" + json.dumps({"x": "b"}) + "\n")
    good, bad = files.read_checked_lines(spark, p, "id long, x string", "id")
    assert rows(good, "id") == [(1, "a")] and bad.count() == 2
    with pytest.raises(Exception):  # noqa: B017
        files.read_json_lines(spark, p, "id long, x string").collect()
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"), spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string")
    assert rows(files.upserted(old, new, ["id"]), "id") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(files.updated(old, new, "id"), "id") == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        files.write_sorted_lines(old.union(old), str(tmp_path / "no"), "id")
    files.write_sorted_lines(old, str(tmp_path / "yes"), "id")
    assert files.read_json_lines(spark, str(tmp_path / "yes"), "id long, x string").count() == 2
    for n, data in (("x.bin", b"one"), ("y.bin", b"one"), ("z.bin", b"two")):
        (tmp_path / n).write_bytes(data)
    inv = files.inventory(spark, str(tmp_path), "*.bin").orderBy(F.desc("n_files")).collect()
    assert [r["n_files"] for r in inv] == [2, 1] and inv[0]["canonical"].endswith("x.bin")


def test_generations(spark, tmp_path):
    g = files.Generations(spark, "file://" + str(tmp_path / "g"))
    fine = g.load(spark.createDataFrame([(1, None), (2, 1)], "id long, parent long"))
    g.publish(fine, "id", "parent")
    chained = g.load(spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent long"))
    with pytest.raises(ValueError):
        g.publish(chained, "id", "parent")
    assert g.active() == fine and g.read().count() == 2 and g.read(chained).count() == 3


def _drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", "file://" + str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_ingress_and_windows(spark, tmp_path):
    schema = "ts timestamp, event_type string, user_id long, value double, k long"
    e = spark.createDataFrame([("2024-01-01 00:05:00", "a", 1, 2.0, 1), ("2024-01-01 00:45:00", "a", 1, 3.0, 2), ("2024-01-01 00:45:00", "a", 1, 3.0, 2), ("2024-01-03 00:00:00", "b", 2, 1.0, 3)], "ts string, event_type string, user_id long, value double, k long").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.json(str(tmp_path / "ev"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "ev"))
    seen = S.first_seen(S.timed(stream, "1 day"), ["k"])
    assert _drain(seen, tmp_path, "seen").count() == 3
    batch = S.tumbling(S.timed(spark.read.schema(schema).json(str(tmp_path / "ev")).dropDuplicates(["k"])))
    assert ("2024-01-01 00:00:00", "a", 2, 5.0) in rows(batch, "start")
    assert _drain(S.tumbling(S.timed(stream, "1 hour")), tmp_path, "tumbling").count() >= 1


def test_outbox(spark):
    m = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "key string")
    t = spark.createDataFrame([("a", True), ("b", False)] + [("c", False)] * 5, "key string, ok boolean")
    assert rows(S.outbox(m, t), "key") == [("a", 1, "delivered"), ("b", 1, "due"), ("c", 5, "dead")]


def test_long_chains_and_circles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(100, 101), (101, 102), (102, 100), (99, 100)], "source long, target long")
    got = {r["source"]: (r["target"], r["steps"]) for r in identity.follow(links).collect()}
    assert got == {i: (70, 70 - i) for i in range(1, 70)} | {i: (None, None) for i in (99, 100, 101, 102)}
    fam = {r["node"]: r["family"] for r in identity.families(links, "source", "target").collect()}
    assert fam == {i: 1 for i in range(1, 71)} | {i: 99 for i in (99, 100, 101, 102)}
    deep = identity.lineage(links.where("source >= 99"), depth=9).collect()
    assert sorted((r["source"], r["ancestor"]) for r in deep if r["source"] == 100) == [(100, 101), (100, 102)]


def test_families_write_a_link_a_few_times(spark, monkeypatch):
    write, sizes = identity.written, []

    def counted(df, label):
        out = write(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(identity, "written", counted)
    links = [(i, i - 1) for i in range(2, 500)] + [(i, i // 3) for i in range(1000, 3000)]
    fam = {r["node"]: r["family"] for r in identity.families(spark.createDataFrame(links, "u long, v long")).collect()}
    assert fam == {x: 1 for x in [*range(1, 500), *range(1000, 1500)]} | {x: x for x in range(500, 1000)} | {x: x // 3 for x in range(1500, 3000)}
    assert sum(sizes) <= 8 * len(links)


@pytest.mark.parametrize("seed", range(3))
def test_families_with_forks_circles_and_loops(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(55)] + [(200 + i, 300) for i in range(5)] + [(7, None), (None, 8), (400, 400)]
    want = {x: x for a, b in links if None not in (a, b) for x in (a, b)}
    for _ in want:
        for a, b in links:
            if None not in (a, b):
                want[a] = want[b] = min(want[a], want[b])
    got = identity.families(spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted((r["node"], r["family"]) for r in got) == sorted(want.items())


def test_null_groups_stay_open(spark):
    t = spark.createDataFrame([(1, None, "es"), (2, None, "en"), (3, "a", None), (4, "a", "en")], "id int, g string, lang string")
    assert sorted(r["id"] for r in fusion.filter_open(t, F.col("lang") == "es", "g").collect()) == [1, 3, 4]


def test_notes_meet_log_by_beginning(spark):
    notes = spark.createDataFrame([(1, "p", "a" * 250), (2, "p", "ab"), (3, "q", "x"), (4, "p", None)], "note int, who string, text string")
    log = spark.createDataFrame([(10, "p", "a" * 200 + "zz", 1), (11, "p", "a" * 200, 2), (12, "p", "abc", 3), (13, "q", "y", 4), (14, "p", None, 5)], "log int, who string, said string, at int")
    got = identity.matched_by_prefix(notes, log, "who", "text", "said", "at", "log", "note")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 11), (2, 12)]


def test_bootstrap_ignores_partitions(spark):
    t = spark.range(500).selectExpr("id", "'g' AS g", "cast(id % 37 as double) AS v", "cast(id % 37 + 1 as double) AS w")
    one, two = (evaluate.bootstrap_mean(t.repartition(n), "g", "v", "id").collect() for n in (1, 5))
    assert one == two and one[0]["low"] < one[0]["mean"] < one[0]["high"]
    d = evaluate.bootstrap_delta(t, "g", "v", "w", "id").collect()[0]
    assert (d["mean"], d["low"], d["high"]) == (1.0, 1.0, 1.0)


def test_batches_are_greedy(spark):
    sizes = {"a": [5, 5, 5, 30, 1, 1, 1, 1], "b": [40, 1]}
    rows = [(g, i, "x" * n) for g, v in sizes.items() for i, n in enumerate(v)]
    got = passages.batches(spark.createDataFrame(rows, "g string, i int, t string"), "g", "i", "t", 3, 20).orderBy("g", "i").collect()
    assert [r["batch"] for r in got] == [0, 0, 0, 1, 2, 2, 2, 3, 0, 1]


def test_windows_cover_the_text(spark):
    t = spark.createDataFrame([(1, "abcdefghij"), (2, "ab"), (3, ""), (4, None)], "id int, t string")
    got = sorted(tuple(r) for r in passages.windows(t, "id", "t", 4, 3).collect())
    assert got == [(1, 0, 4, "abcd"), (1, 3, 7, "defg"), (1, 6, 10, "ghij"), (2, 0, 2, "ab")]
    lines = spark.createDataFrame([(1, "ab\n\ncd")], "id int, t string")
    assert sorted(tuple(r) for r in passages.line_spans(lines, "id", "t").collect()) == [(1, 0, 2, "ab"), (1, 4, 6, "cd")]


def test_pairs_in_groups_block_by_block(spark, monkeypatch):
    """The same pairs, each once, however a group is cut; odd vectors as in the join of a group with itself."""
    rng = np.random.default_rng(4)
    sound = [(i, "x" if i % 3 else "y", [float(np.float32(c)) for c in rng.normal(size=4)]) for i in range(60)]
    odd = [(60, "x", None), (61, "x", [0.0] * 4), (62, "x", [1.0, None, 0.0, 0.0]), (63, "x", [1.0, 1.0]), (64, "x", [2.0, 2.0]), (65, None, [1.0] * 4), (None, "x", [1.0] * 4), (1, "x", [1.0] * 4), (66, "x", [float("nan")] * 4)]
    rows = spark.createDataFrame(sound + odd, "vec_id long, label string, embedding array<float>")
    a, b = (rows.select("label", F.col("vec_id").alias(n), F.col("embedding").alias("v" + n)) for n in "ab")
    plain = a.join(b, "label").where("a < b").select("label", "a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("similarity")).where("similarity >= 0.35")
    want = sorted(map(str, plain.collect()))
    for block, stripe in ((5, 3), (7, 100), (2048, 256)):
        monkeypatch.setattr(vector, "BLOCK", block)
        monkeypatch.setattr(vector, "STRIPE", stripe)
        found = vector.pairs_in_groups(rows, "label", 0.35)
        assert sorted(map(str, found.collect())) == want and len(want) > 100
        # no join of a group with itself
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_protected_prefix_ranks_its_lists_once(spark, sf_dir):
    """What follows the two short lists reads them and not the vectors again."""
    from quarrylight.plans import serving

    plan = serving.protected_prefix(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding" not in plan and "Relation" in plan


@pytest.mark.parametrize("same", [None, "label"])
def test_top_k_in_steps(spark, monkeypatch, same):
    """Steps and query blocks change nothing; a task gives k rows a query, not k of each step; ties by id across steps."""
    rng = np.random.default_rng(6)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.normal(size=3)]) for i in range(200)] + [(300 - i, "a", [1.0, 2.0, 2.0]) for i in range(20)]
    v = spark.createDataFrame(rows + [(400, "a", None), (401, None, [1.0, 2.0, 2.0]), (402, "a", [0.0] * 3)], "vec_id long, label string, embedding array<float>").coalesce(1)
    q = v.where("vec_id % 50 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    want = sorted(map(str, vector.top_k(v, q, 4, 0.1, same=same).collect()))
    monkeypatch.setattr(vector, "CELLS", 40)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    assert sorted(map(str, vector.top_k(v, q, 4, 0.1, same=same).collect())) == want
    s = np.round(np.array([r[2] for r in rows]) @ np.array([1, 2, 2]) / 3 / np.linalg.norm([r[2] for r in rows], axis=1), 6)
    mine = [(-x, r[0]) for x, r in zip(s, rows, strict=True) if not same or r[1] == "a"] + ([] if same else [(-1.0, 401)])
    got = [r["vec_id"] for r in vector.top_k(v, q, 4, 0.1, same=same).where("query_id = 300").orderBy("rank").collect()]
    assert got == [i for _, i in sorted(mine)[:4]]


def test_notes_are_filed_by_beginning(spark, monkeypatch):
    """The same pairs at every LEVEL; a log row is spelled out for the notes that begin as it does, not for all of its person."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(0, 12, 120)]
    notes, log = [(i, "pq"[i % 2], w) for i, w in enumerate(words[:60])], [(i, "pq"[i % 2], w, i * 7 % 11) for i, w in enumerate(words[60:])]
    want = {(i, max((at, j) for j, o, t, at in log if o == p and t.startswith(w[:9]))[1]) for i, p, w in notes if any(o == p and t.startswith(w[:9]) for _, o, t, _ in log)}
    n, l = spark.createDataFrame(notes, "note int, who string, text string"), spark.createDataFrame(log, "log int, who string, said string, at int")
    for level in (1, 3, 40):
        monkeypatch.setattr(identity, "LEVEL", level)
        assert {tuple(r) for r in identity.matched_by_prefix(n, l, "who", "text", "said", "at", "log", "note", 9).collect()} == want and len(want) > 20


def test_weighted_match_leaves_few_rows_in_a_task(spark, monkeypatch):
    """Every document has a term of every query: no more than k rows for each query leave a task, and the result is the same."""
    from quarrylight.operators import lexical

    rows = [(i % 290, ["all", f"t{i % 7}"], [f"t{i % 5}"]) for i in range(300)] + [(None, ["all"], ["t1"])]
    docs = spark.createDataFrame(rows, "doc_id long, a array<string>, b array<string>").repartition(3)
    asked = [(q, ["all", f"t{q % 7}", "none", "all"]) for q in range(11)] + [(11, []), (12, ["none"])]
    queries = spark.createDataFrame(asked, "item_id long, words array<string>")
    weights: dict = {}
    for doc, a, b in rows:
        for words, w in ((a, 1.0), (b, 0.4)):
            for t in words:
                weights.setdefault(doc, {})[t] = max(w, weights.get(doc, {}).get(t, 0))
    for every in (False, True):
        want = []
        for q, words in asked:
            words = set(words) - ({"none"} if not every else set())
            hits = [(-round(sum(own.get(t, 0) for t in words), 6), -1 if doc is None else doc, sum(t in own for t in words)) for doc, own in weights.items()]
            hits = sorted(h for h in hits if h[2] and (not every or h[2] == len(words)))[:4]
            want += [(q, doc, n, -s, i + 1) for i, (s, doc, n) in enumerate(hits)]
        for cells, block in ((1 << 19, 2048), (7, 3)):
            monkeypatch.setattr(lexical, "CELLS", cells)
            monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
            got = lexical.weighted_match(docs, queries, {"a": (F.col("a"), 1.0), "b": (F.col("b"), 0.4)}, F.col("words"), k=4, every_term=every)
            assert sorted((r.item_id, -1 if r.doc_id is None else r.doc_id, r.n_terms, r.score, r.rank) for r in got.collect()) == sorted(want)
    terms = docs.select("doc_id", F.col("a").alias("term"), F.transform("a", lambda _: F.lit(1.0)).alias("weight"))
    q = queries.select("item_id", F.explode(F.array_distinct("words")).alias("term"))
    assert lexical.best_matches(terms, q, "doc_id", "item_id", 4, False).count() <= 3 * 3 * 4 * 11


def test_texts_are_taken_apart_once(spark):
    """No filter makes the tokens or shingles again, and gold is found once."""
    from quarrylight.operators import lexical

    def filtered(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return [line for line in plan.splitlines() if "Filter" in line and "split(" in line]

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "b c d e f g")], "doc_id long, text string")
    asked = docs.withColumnRenamed("doc_id", "item_id").where("item_id = 1")
    items, own = T.shingle_hashes(T.words(F.col("text")), 5), F.array(F.lit(0).cast("long"))
    got = lexical.overlap(docs, asked.withColumn("own", items), items, F.col("own"))
    assert sorted((r.doc_id, r.n_common) for r in got.collect()) == [(1, 2), (3, 1)]
    assert len(filtered(lexical.overlap(docs, asked.select("item_id", own.alias("own")), items, F.col("own")))) == 0
    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    gold = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "query long, id long").mapInArrow(once, "query long, id long")
    hits = spark.createDataFrame([(1, 6, 2), (2, 8, 1)], "query long, id long, rank int")
    assert [tuple(r) for r in evaluate.retrieval_metrics(hits, gold, 10).orderBy("query").collect()] == [(1, 2, 1, 0.5, 0.5), (2, 1, 0, 0.0, 0.0)]
    assert seen.value == 3
