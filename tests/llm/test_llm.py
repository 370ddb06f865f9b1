import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylight.llm import byte_bpe, common, embedding_dedup, fingerprint, langid, license_scan, line_dedup, mixing, order_minhash, substring, textkit, token_pack
from quarrylight.llm import queries as q

P = pytest.importorskip("public_tokenizers")
SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "one", "en", "a"), (3, "one", "en", "a"), (None, "two words", None, "b"), (4, "long " * 30_000 + "end", "en", None), (5, " \n\t ", "fr", "a"), (6, "été là-bas où ça va bien\nMIT License", "fr", "b"), (7, "été là-bas où ça va bien\nMIT License", "de", "c")]
    names = ["_text", "body", "_cut", "_t", "text_hash", "cut_lines", "_source", "_lang", "source_axis", "chance", "t1", "keys", "range", "n_words", "spans", "id", "rep", "n", "form", "low", "topic", "probability", "n_removed", "lang_pred", "licences"]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({n: F.lit(7) for n in names}).withColumn("n_chars", F.length("text").cast("long"))


def by_id(df):
    return df.toPandas().sort_values("doc_id").reset_index(drop=True)


def groups_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_oracles(spark, sf_dir):
    con = oracle.connect(sf_dir)
    for name, sql in q.ORACLE_SQL.items():
        assert oracle.differences(q.QUERIES[name](spark, sf_dir), con, sql) == [], name


def test_op1_ids_and_random_access(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer_file("word_bpe_49k.json"))
    want = [[*e.ids, 1] for e in t.encode_batch(docs.text.fillna("").tolist(), add_special_tokens=False)]
    got = by_id(q.op1_token_pack(spark, sf_dir))
    assert got.n_tokens.tolist() == [len(w) for w in want]
    assert got.start.tolist() == np.r_[0, np.cumsum([len(w) for w in want])][:-1].tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    shards = token_pack.write_shards(common.table(spark, sf_dir, "documents"), q.tokenizer_file("word_bpe_49k.json"), 49408, 1, shard_ids=20_000)
    for r in shards.collect():
        s = token_pack.Shard(r["path"])
        k = len(s.doc_ids) // 2
        assert s.document(k).tolist() == want[docs.doc_id.tolist().index(s.doc_ids[k])]


def test_op1_added_tokens_and_a_small_cache(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = q.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    names = [x.content for x in t.get_added_tokens_decoder().values()]
    texts = [f"one {n}two{n} three" for n in names] + [n.upper() for n in names] + [n[:-1] + " >" for n in names] + ["Straße İstanbul ǅ 'S we'LL #1!? x.y, 漢字 🙂", "word " * 50] + [f"w{i} v{i % 7} {i}." for i in range(200)]
    monkeypatch.setattr(token_pack, "CACHE_WORDS", 20)
    e = token_pack.WordEncoder(path)
    for i in range(0, len(texts), 9):
        part = texts[i : i + 9]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([x.encode() for x in part])] == [t.encode(x, add_special_tokens=False).ids for x in part]


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_op1_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000).astype(np.uint32)
    data = token_pack.pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8) and (token_pack.unpack(data, bits, 1000) == ids).all()


def test_op3_brute_force(spark, sf_dir, docs):
    w = [t.encode().split() for t in docs.text.fillna("")]
    first = {}
    for i, x in enumerate(w):
        for j in range(len(x) - 12):
            first.setdefault(tuple(x[j : j + 13]), i)
    got = by_id(q.op3_substring_dedup(spark, sf_dir))
    n_gone = 0
    for i, x in enumerate(w):
        gone = np.zeros(len(x), bool)
        for j in range(len(x) - 12):
            if first[tuple(x[j : j + 13])] < i:
                gone[j : j + 13] = True
        n_gone += gone.sum()
        kept = b" ".join(y for y, g in zip(x, gone, strict=True) if not g)
        assert (got.n_words[i], got.n_removed[i], got.kept_sha256[i]) == (len(x), gone.sum(), hashlib.sha256(kept).hexdigest())
    assert n_gone > 100


def test_op3_overlapping_repeats(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        parts = [" ".join(map(str, np.arange(a, a + n) % 50)) for a, n in zip(rng.integers(0, 50, 3).tolist(), rng.integers(5, 30, 3).tolist(), strict=True)]
        rows.append((i, " ".join(parts)))
    first, want = {}, []
    for i, t in rows:
        x = t.split()
        for j in range(len(x) - 12):
            first.setdefault(tuple(x[j : j + 13]), i)
    for i, t in rows:
        x, gone = t.split(), set()
        for j in range(len(x) - 12):
            if first[tuple(x[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        want.append(len(gone))
    got = by_id(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got.n_removed.tolist() == want


def test_op4_held_out_accuracy(spark, docs):
    d = "/root/testdata/sf0.01"
    got = by_id(q.op4_language_id(spark, d))
    lang = pd.read_parquet(f"{d}/documents.parquet").sort_values("doc_id").lang.tolist()
    held = got.held_out.to_numpy()
    assert held.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    assert (got.lang_pred == lang)[held].mean() > 0.97
    assert got.score.between(0, 1).all()


def test_op4_steps_of_long_texts():
    """Texts that a step cuts, empty and short ones beside them: as if scored in one piece."""
    rng = np.random.default_rng(0)
    size = [5, 0, 2 * langid.SCORE_STEP + 7, 1, langid.SCORE_STEP, 0]
    buf, off = rng.integers(97, 123, sum(size)).astype(np.uint8), np.r_[0, np.cumsum(size)]
    seen, n = np.unique(langid._grams(buf[:100_000], np.array([0, 100_000])), return_counts=True)
    model = langid.Model(["a", "b"], seen, np.stack([n, n - 1], 1).astype(float))
    each = model._cost(langid._grams(buf, off), langid.ORDER)
    want = [each[a:b].sum(0) for a, b in zip(off[:-1], off[1:], strict=True)]
    np.testing.assert_allclose(model.bits(buf, off), want, rtol=1e-9)


def test_op4_code_lengths(spark):
    """Against escapes counted one by one."""
    train = spark.createDataFrame([("abab", "x"), ("abac", "x"), ("bbbb", "y")], "text string, lang string")
    m = langid.train(train)
    counts = {k: defaultdict(Counter) for k in m.langs}
    for text, lang in (("abab", "x"), ("abac", "x"), ("bbbb", "y")):
        s = [10] * 3 + list(text.encode())
        for i in range(3, len(s)):
            for o in range(4):
                counts[lang][tuple(s[i - o : i])][s[i]] += 1

    def bits(text, lang):
        s, total = [10] * 3 + list(text.encode()), 0.0
        for i in range(3, len(s)):
            for o in (3, 2, 1, 0):
                c = counts[lang].get(tuple(s[i - o : i]))
                if not c:
                    continue
                n, k = sum(c.values()), len(c)
                if s[i] in c:
                    total -= np.log2(c[s[i]] / (n + k))
                    break
                total -= np.log2(k / (n + k))
            else:
                total += 8
        return total

    texts = ["abac", "zb", "bca", "aabb", "ж漢b", "abab" * 50]
    got = m.bits(*textkit.raw(pa.array(texts)))
    assert np.allclose(got, [[bits(t, k) for k in m.langs] for t in texts], atol=1e-3)


def test_op5_families(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    text = pd.read_parquet(f"{d}/documents.parquet").sort_values("doc_id").text
    got = by_id(q.op5_license_scan(spark, d))
    assert got.families.tolist() == [",".join(sorted({v for k, v in lines.items() if k in t})) for t in text]
    assert (got.n_licence_units > 0).sum() > 20


def test_op5_unknown_and_plain(spark):
    model = license_scan.train([" ".join(np.random.default_rng(i).choice("the of a river stone house walks by under open free use public general version work is this rain".split(), 12)) for i in range(400)])
    new = ["This book is licensed under the Quux Share License, version 9.", "The river is free and open to the public for general use.", "See the file. Licensed under the Apache License, Version 2.0, please.", "word " * 70 + "Released under the MIT License. " + "word " * 70, "", None]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), model)
    assert [[x["family"] for x in r["licences"]] for r in got.orderBy("doc_id").collect()] == [["unknown"], [], ["apache-2.0"], ["mit"], [], []]


def _shingles(t, k=5):
    w = t.encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_op6_fingerprints(spark, sf_dir, docs):
    got = by_id(q.op6_fingerprint(spark, sf_dir))
    t = docs.text.fillna("").tolist()
    edited = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in zip(t, t[1:] + t[:1], strict=True)]
    assert got.n_chars.tolist() == [len(x) for x in t]
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    exact = np.array([len(_shingles(a) & _shingles(b)) / max(1, len(_shingles(a) | _shingles(b))) for a, b in zip(t, edited, strict=True)])
    assert np.abs(exact - got.near_edited).mean() < 0.05 and np.abs(exact - got.near_edited).max() < 0.2
    assert got.groupby(docs.text).fingerprint.nunique().max() == 1


def test_op6_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    rows = [(int(i), f"text {i} " * int(i % 9)) for i in np.random.default_rng(0).choice(10_000, 120, replace=False)]
    got = by_id(fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)))
    rows.sort()
    t = [r[1] for r in rows]
    edited = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in zip(t, t[1:] + t[:1], strict=True)]
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]


def _copies(seed, n=25, words=120, near=4, edits=4):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = rng.integers(0, 5000, words).tolist()
        for _ in range(near):
            c = list(base)
            for p in rng.integers(0, words, int(rng.integers(0, edits))).tolist():
                c[p] = int(rng.integers(5000, 9000))
            out.append(" ".join(map(str, c)))
    return [out[i] for i in rng.permutation(len(out))]


def test_op6_classes(spark):
    texts = _copies(1)
    s = [_shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(s)) for b in range(a) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    got = by_id(fingerprint.duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert len(pairs) > 30 and got.class_id.tolist() == groups_of(len(texts), pairs)


def test_op6_query_gives_classes(spark, sf_dir, docs):
    got = by_id(q.op6_fingerprint(spark, sf_dir))
    s = [_shingles(t) for t in docs.text.fillna("")]
    at = defaultdict(list)
    for i, x in enumerate(s):
        for g in x:
            at[g].append(i)
    shared = Counter((b, a) for m in at.values() for j, a in enumerate(m) for b in m[:j])
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * len(s[a] | s[b])]
    pairs += [(a, b) for m in docs.groupby("text").indices.values() for a, b in zip(m, m[1:], strict=False)]
    assert len(pairs) > 10 and got.class_id.tolist() == docs.doc_id.iloc[groups_of(len(s), pairs)].tolist()
    assert (got.kept == (got.doc_id == got.class_id)).all() and not got.kept.all()


def _distance(a, b):
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.r_[i, np.minimum(row[:-1] + np.array([x != y for y in b]), row[1:] + 1)]
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def test_op7_alignment():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 40, int(rng.integers(1, 60))).astype(np.uint32)
        b = a[rng.random(len(a)) > rng.choice([0.02, 0.1, 0.4])]
        at = rng.integers(0, len(b) + 1, int(rng.integers(0, 5)))
        b = np.insert(b, at, 77).astype(np.uint32)
        if not len(b):
            continue
        d, longest = _distance(a.tolist(), b.tolist()), max(len(a), len(b))
        band = int(0.2 * longest + 1e-9)
        assert order_minhash.banded_distance(a, b, band) == d if d <= band else order_minhash.banded_distance(a, b, band) > band
        assert (order_minhash.edit_similarity(a, b) >= 0.8 - 1e-9) == (d <= band)


def test_op7_classes(spark):
    texts = _copies(2, edits=8)
    w = [t.split() for t in texts]
    pairs = [(a, b) for a in range(len(w)) for b in range(a) if len(set(w[a]) & set(w[b])) > 60 and _distance(w[a], w[b]) <= 24]
    got = by_id(order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got.class_id.tolist() == groups_of(len(texts), pairs)


def test_op7_one_large_group_and_a_shared_passage(spark):
    rng = np.random.default_rng(8)
    base, passage = rng.integers(0, 5000, 100), " ".join(map(str, rng.integers(20000, 30000, 60)))
    texts = []
    for _ in range(700):
        c = base.copy()
        c[rng.integers(0, 100, 3)] = rng.integers(5000, 9000, 3)
        texts.append(" ".join(map(str, c)))
    texts += [passage + " " + " ".join(map(str, rng.integers(0, 5000, 60))) for _ in range(200)]
    got = by_id(order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got.class_id.tolist() == [0] * 700 + list(range(700, 900))


def _edited_pairs(seed, n=100):
    """(similarity, words, text, edited text): as many words replaced, at random places, as the similarity allows."""
    rng = np.random.default_rng(seed)
    for similarity in (0.8, 0.85, 0.9):
        for words in (10, 30, 61, 120, 400):
            for _ in range(n):
                a = rng.integers(0, 50_000, words)
                b = a.copy()
                at = rng.choice(words, int((1 - similarity) * words + 1e-9), replace=False)
                b[at] = rng.integers(50_000, 100_000, len(at))
                yield similarity, words, a.tolist(), b.tolist()


def test_op7_recall_pair_by_pair(spark):
    pairs = list(_edited_pairs(17))
    near = [_distance(a, b) <= 0.2 * n + 1e-9 for _, n, a, b in pairs]
    texts = [" ".join(map(str, t)) for _, _, a, b in pairs for t in (a, b)]
    got = by_id(order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).class_id.tolist()
    found = defaultdict(list)
    for i, (similarity, words, _, _) in enumerate(pairs):
        assert got[2 * i] == 2 * i and got[2 * i + 1] in (2 * i, 2 * i + 1)
        found[similarity, words].append(got[2 * i + 1] == 2 * i)
    recall = {k: sum(v) / len(v) for k, v in found.items()}
    print(recall)
    assert all(near) and min(recall.values()) >= 0.97, recall


def test_op8_recall_and_counts(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MEMBERS", 40)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 64))
    v = np.repeat(base, 4, axis=0) + rng.standard_normal((600, 64)) * rng.choice([0.1, 0.25, 0.45], (600, 1))
    v = np.concatenate([v, v[:30], v[:10], np.zeros((2, 64))]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, [1.0, None]), (9002, [float("nan")] * 64), (9003, [])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().sort_values("vec_id").reset_index(drop=True)
    u = v.astype(np.float64)
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    n = len(v)
    want = g.sum(1)
    assert got.n_links[:n].sum() >= 0.97 * want.sum() and (got.n_links[:n] <= want).all()
    assert (got.component_id[:n] == groups_of(n, np.argwhere(g))).mean() > 0.97
    assert got.n_links[n - 2 :].tolist() == [0] * 6 and (got.kept == (got.vec_id == got.component_id)).all()


def test_op9_as_the_library(spark, sf_dir, docs):
    import tiktoken

    ranks = byte_bpe.load_ranks(q.tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = ["I'll don't we've IT'S 'tis 's''s", "  two  spaces \n\n x\t\ty ", "ünïcödé 漢字かな 🙂🙂 ٣٤", "x" * 1500 + " " + "ab" * 500, "    z", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    for frame, texts in ((d, extra), (common.table(spark, sf_dir, "documents"), docs.text.tolist())):
        got = by_id(byte_bpe.encode_decode(frame, q.tokenizer_file("byte_bpe_multi_50k.tiktoken")))
        ids = [enc.encode_ordinary(t or "") for t in texts]
        assert got.n_tokens.tolist() == [len(x) for x in ids]
        assert got.ids_sha256.tolist() == [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids]
        assert got.decoded_sha256.tolist() == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]


def test_op9_one_python_worker_to_a_task_and_short_lists(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", 40)
    texts = [f"the word{i} and only{i}é" for i in range(25)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = byte_bpe.encode_decode(docs, q.tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # each would have a worker of its own, with its own tables
    rows = by_id(got)
    assert rows.decoded_sha256.tolist() == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]


@pytest.mark.parametrize("given", [False, True])
def test_op10_marginals(spark, given):
    rng = np.random.default_rng(2)
    rows = [(i, f"{'# ' * int(rng.integers(0, 2))}word {'7 ' if i % 3 else ''}" * int(rng.integers(1, 60)), "en" if rng.random() < 0.7 else "fr", f"s{min(int(rng.integers(0, 9)), 3)}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 1.0, "s1": 0.5, "s2": 0.5, "s3": 2.0, "none": 9.0}, "lang": {"en": 1.0, "fr": 1.0}} if given else {}
    found = mixing.mix(docs, {a: spark.createDataFrame(list(t.items()), "value string, share double") for a, t in targets.items()}).toPandas()
    goal = mixing.BUDGET * found.n_tokens.sum()
    expected = found.assign(w=found.probability * found.n_tokens)
    assert abs(expected.w.sum() / goal - 1) < 0.001 and found.probability.between(0, 1).all()
    for axis in ("source", "lang", "topic"):
        has = found.groupby(axis).n_tokens.sum()
        share = pd.Series(targets.get(axis, has**mixing.SOFTEN)).reindex(has.index).fillna(0.0)
        low, high = 0.0, 1e12
        for _ in range(200):  # the level at which the targets, cut to what there is, sum to the goal
            mid = (low + high) / 2
            low, high = (mid, high) if np.minimum(has, share * mid).sum() < goal else (low, mid)
        assert (expected.groupby(axis).w.sum() - np.minimum(has, share * high)).abs().sum() <= 2 * mixing.TOLERANCE * goal, axis


def test_odd_rows(spark, odd):
    small = q.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    n = odd.count()
    model = license_scan.train([])
    lang = langid.train(odd)
    runs = {
        "op1": lambda d: token_pack.read_digests(token_pack.write_shards(d, q.tokenizer_file("word_bpe_49k.json"), 49408, 1)),
        "op2": line_dedup.remove_boilerplate,
        "op3": substring.remove_repeats,
        "op4": lambda d: langid.predict(d, lang),
        "op5": lambda d: license_scan.scan(d, model),
        "op6": fingerprint.fingerprints,
        "op6 classes": fingerprint.duplicate_classes,
        "op7": order_minhash.near_duplicates,
        "op9": lambda d: byte_bpe.encode_decode(d, small),
        "op10": mixing.mix,
    }
    for name, run in runs.items():
        assert run(odd).count() == n, name
        assert run(odd.limit(0)).count() == 0, name
    c = {(r["doc_id"]): r["class_id"] for r in order_minhash.near_duplicates(odd).collect()}
    assert c == {1: 1, 2: 2, 3: 3, None: None, 4: 4, 5: 5, 6: 6, 7: 6}
    v = spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [0.0, 1.0], 3), (None, [1.0, 0.0], 3), (2, [2.0, 0.0], 3), (2, [2.0, 0.0], 3)], "vec_id long, embedding array<double>, size int")
    assert sorted((str(r[0]), r[1], r[2]) for r in embedding_dedup.near_duplicates(v).select("vec_id", "n_links", "component_id").collect()) == [("1", 0, 1), ("1", 2, 1), ("2", 2, 1), ("2", 2, 1), ("None", 0, None)]
    assert embedding_dedup.near_duplicates(v.limit(0)).count() == 0


def test_pipeline(spark, sf_dir, docs, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line dedup", "near copies", "mixture", "token ids"]
    frame, sizes = common.table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, frame = frame, common.written(stage(spark, frame, sf_dir), "stage")
        assert set(frame.columns) == set(docs.columns), name
        if name == "near copies":
            c = {r["doc_id"] for r in order_minhash.near_duplicates(before).where("doc_id = class_id").collect()}
            assert {r["doc_id"] for r in frame.select("doc_id").collect()} == c
        sizes.append(frame.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.count() == sizes[-1]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.select(*docs.columns), sf_dir).count() >= 0, name
        assert stage(spark, odd.select(*docs.columns).limit(0), sf_dir).count() == 0, name


def test_block_links_join_all_alike(spark, monkeypatch):
    """A frequent root in several slices, the others in several blocks: the links tie the same members as brute force does."""
    from quarrylight.llm import similar

    root = [100] * 20 + list(range(200, 220))
    form = [1000 + i for i in range(20)] + [i // 2 for i in range(20, 40)]
    form[5], form[19] = 15, 11  # two of the frequent root, like 30 and 31 and like 22 and 23
    want = {tuple(sorted((root[a], root[b]))) for a in range(40) for b in range(a) if form[a] == form[b] and root[a] != root[b]}

    def tied(links):
        head = {r: r for r in root}
        for a, b in links:
            low, high = sorted((head[a], head[b]))
            head = {r: low if h == high else h for r, h in head.items()}
        return head

    members = spark.createDataFrame([(1, 0, i, 10, r) for i, r in enumerate(root)], "k long, band int, id long, n_words long, root long")
    keys = spark.createDataFrame([(i, [7]) for i in range(40)], "id long, keys array<bigint>")
    forms = spark.createDataFrame([(i, bytearray(np.array([x], np.uint32).tobytes())) for i, x in enumerate(form)], "id long, form binary")
    method = similar.Method(keys=None, forms=None, alike=lambda a, b: bool(a[0] == b[0]), near=lambda both, others, one: both >= 1, least_length=0.8)
    for size in (3, 7, 512):
        monkeypatch.setattr(similar, "BLOCK", size)
        got = {tuple(sorted(x)) for x in similar._block_links(members, keys, forms, method).collect()}
        assert got <= want
        assert tied(got) == tied(want)
