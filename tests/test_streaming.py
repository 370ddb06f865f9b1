"""Streams with state, the incremental sink and the dispatch source."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quarrylight.operators.gate import Gate, Throttle, replay
from quarrylight.streaming import incremental, stateful

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def streamed(spark, path, batches, schema):
    """A stream that takes one batch at a time."""
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"file://{path}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}")


def drained(df, path, name):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"file://{path}/check-{name}").option("path", f"file://{path}/out-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"file://{path}/out-{name}")


def state(spark, path, name, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(f"file://{path}/check-{name}")


RULE = Throttle(free=2, base=10.0, most=60.0, retention=100.0, cap=3)


def test_gate_waits_prunes_and_keeps_the_cap():
    g = Gate(RULE, {})
    assert [g.admit(t, ["u"]) for t in (0, 1, 2, 3, 12, 13, 40)] == [0, 0, 0, 9, 0, 19, 0]  # blocked tries don't count
    assert g.tries["u"] == (5, 40)
    assert g.admit(41, ["u", "ip"]) > 0 and "ip" not in g.tries  # one blocked key blocks, and seeds nothing
    for k, t in (("a", 50), ("b", 51), ("c", 52)):
        assert g.admit(t, [k]) == 0
    assert set(g.tries) == {"a", "b", "c"}  # the longest untried went
    assert g.admit(53, ["a", "d"]) == 0 and set(g.tries) == {"c", "a", "d"}
    assert g.admit(1000, ["z"]) == 0 and set(g.tries) == {"z"}
    with pytest.raises(ValueError):
        g.admit(1001, list("wxyz"))


def test_throttle_state_ends(spark, tmp_path):
    rows = [[("z", i, at(t), ["u"]) for i, t in enumerate((0, 1, 2))], [("z", 3, at(3), ["u"]), ("z", 4, at(12), ["u"]), ("y", 1, at(12), ["v"])], [("z", 5, at(13), ["u"])], [("x", 1, at(10_000), ["w"])], [("x", 2, at(10_001), ["w"])]]
    src = streamed(spark, tmp_path / "src", rows, "zone string, seq long, ts timestamp, keys array<string>")
    out = drained(stateful.throttled(src, RULE), tmp_path, "throttle")
    assert sorted((r.zone, r.seq, r.wait) for r in out.collect()) == [("x", 1, 0), ("x", 2, 0), ("y", 1, 0), ("z", 0, 0), ("z", 1, 0), ("z", 2, 0), ("z", 3, 9), ("z", 4, 0), ("z", 5, 19)]
    assert [r.key.zone for r in state(spark, tmp_path, "throttle", "tries").select("key").collect()] == ["x"]
    whole = spark.createDataFrame([r for b in rows for r in b], "zone string, seq long, ts timestamp, keys array<string>").withColumn("at", F.col("ts").cast("double"))
    assert sorted(tuple(r) for r in replay(whole, RULE).collect()) == sorted(tuple(r) for r in out.collect())


def test_leases_run_out_on_timers(spark, tmp_path):
    one = [("c", 1, at(0), "claim", "w1", 0), ("c", 2, at(5), "claim", "w2", 0), ("d", 1, at(0), "claim", "w1", 0), ("d", 2, at(20), "heartbeat", "w1", 1), ("d", 3, at(45), "complete", "w1", 1)]
    two = [("c", 3, at(40), "claim", "w2", 0), ("c", 4, at(41), "heartbeat", "w1", 1), ("c", 5, at(42), "odd", "w2", 2), ("e", 1, at(2000), "claim", "w9", 0)]
    three = [("e", 2, at(2001), "heartbeat", "w9", 1)]
    four = [("e", 3, at(9000), "claim", "w9", 0)]
    schema = "conv string, seq long, ts timestamp, request string, holder string, token long"
    src = streamed(spark, tmp_path / "src", [one, two, three, four, [("e", 4, at(9001), "complete", "w9", 2)]], schema)
    out = drained(stateful.leases(src, ttl=30, keep=1000), tmp_path, "leases")
    got = {c: [(int(r.at - T0.replace(tzinfo=datetime.UTC).timestamp()), r.request, r.granted, r.token, r.status) for r in sorted((r for r in out.collect() if r.conv == c), key=lambda r: (r.at, r.request != "expired"))] for c in "cde"}
    assert got["c"] == [(0, "claim", True, 1, "running"), (5, "claim", False, 1, "running"), (30, "expired", True, 1, "free"), (40, "claim", True, 2, "running"), (41, "heartbeat", False, 2, "running"), (42, "odd", False, 2, "running"), (70, "expired", True, 2, "free")]
    assert got["d"] == [(0, "claim", True, 1, "running"), (20, "heartbeat", True, 1, "running"), (45, "complete", True, 1, "done")]
    assert got["e"][-2:] == [(9000, "claim", True, 2, "running"), (9001, "complete", True, 2, "done")] and (2031, "expired", True, 1, "free") in got["e"]
    assert [r.key.conv for r in state(spark, tmp_path, "leases", "lease").select("key").collect()] == ["e"]  # the others ended


def test_daily_quota_ends_with_the_day(spark, tmp_path):
    src = streamed(spark, tmp_path / "src", [[("p", i, at(i)) for i in range(3)], [("p", i, at(i)) for i in range(3, 6)], [("p", 9, at(200_000))], [("p", 10, at(200_001))]], "person string, seq long, ts timestamp")
    out = drained(stateful.daily_quota(src, 4), tmp_path, "quota")
    assert sorted((r.seq, r.allowed) for r in out.collect()) == [(0, True), (1, True), (2, True), (3, True), (4, False), (5, False), (9, True), (10, True)]
    assert state(spark, tmp_path, "quota", "used").count() == 1


def test_deliveries_with_late_attempts_and_dead_letters(spark, tmp_path):
    minute = lambda m: at(60 * m)
    messages = [[("ok", minute(0)), ("dead", minute(0)), ("due", minute(1)), ("silent", minute(2))], [("last", minute(600))], [("end", minute(1200))]]
    attempts = [[("ok", minute(1), False), ("dead", minute(1), False), ("dead", minute(2), False), ("due", minute(3), False)], [("ok", minute(5), True), ("dead", minute(4), False), ("silent", minute(200), True)], [("none", minute(1200), True)]]
    m = streamed(spark, tmp_path / "m", messages, "key string, at timestamp")
    a = streamed(spark, tmp_path / "a", attempts, "key string, tried_at timestamp, ok boolean")
    got = drained(stateful.deliveries(m, a, most=3), tmp_path, "deliveries")
    want = [("dead", 3, "dead"), ("due", 1, "due"), ("ok", 2, "delivered"), ("silent", 0, "due")]  # an attempt beyond the horizon does not count
    assert [r for r in sorted((r.key, r.n_attempts, r.status) for r in got.collect()) if r[0] not in ("last", "end")] == want
    flat = lambda x, s: spark.createDataFrame([r for b in x for r in b], s)
    batch = stateful.deliveries(flat(messages, "key string, at timestamp"), flat(attempts, "key string, tried_at timestamp, ok boolean"), most=3)
    assert sorted((r.key, r.n_attempts, r.status) for r in batch.collect()) == sorted([*want, ("last", 0, "due"), ("end", 0, "due")])


def test_incremental_classification(spark, tmp_path):
    from quarrylight.sources.store import Store

    calls = spark.sparkContext.accumulator(0)

    def classify(rows):
        def label(x):
            calls.add(1)
            return x.upper()

        return rows.withColumn("label", F.udf(label)("text"))

    frame = lambda rows: spark.createDataFrame(rows, "id long, created_at long, text string")
    store = Store(spark, f"file://{tmp_path}/store")
    job = incremental.Classification(store, classify, 1, limit=3)
    first = frame([(1, 10, "a"), (2, 9, "b"), (2, 11, "again"), (3, 8, "c"), (4, 12, "d"), (None, 1, "n")])
    job(first, 0)
    now = lambda: sorted(tuple(r) for r in job.results().select("id", "label", "taxonomy").collect())
    assert now() == [(1, "A", 1), (2, "B", 1), (3, "C", 1)] and calls.value == 3
    job(first, 0)  # replayed
    assert now() == [(1, "A", 1), (2, "B", 1), (3, "C", 1)] and calls.value == 3 and store.generation() == 1
    job.taxonomy = 2
    job(frame([(1, 1, "changed"), (5, 1, "e")]), 1)  # never classified first, then the older taxonomy
    assert now() == [(1, "A", 1), (2, "B", 1), (3, "C", 2), (4, "D", 2), (5, "E", 2)] and calls.value == 6
    src = streamed(spark, tmp_path / "src", [[(6, 1, "f")]], "id long, created_at long, text string")
    job = incremental.Classification(Store(spark, f"file://{tmp_path}/other"), classify, 2)
    src.writeStream.foreachBatch(job).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert now() == [(6, "F", 2)] and calls.value == 7


def test_dispatch_source(spark, tmp_path):
    from quarrylight.sources import dispatch

    dispatch.register(spark)
    for root, names in (("disk", "ab"), ("bucket", "bcd")):
        (tmp_path / root).mkdir()
        for n in names:
            (tmp_path / root / f"{n}.json").write_text(json.dumps({"from": root, "name": n}))
    (tmp_path / "disk" / "other.txt").write_text("no object")
    roots = f"file://{tmp_path}/disk;file://{tmp_path}/bucket;file://{tmp_path}/nowhere"
    read = lambda **o: spark.read.format("dispatch").options(roots=roots, **o).load()
    assert {(r.name, r.root, json.loads(r.content)["from"]) for r in read().collect()} == {("a", 0, "disk"), ("b", 0, "disk"), ("c", 1, "bucket"), ("d", 1, "bucket")}
    assert {(r.name, r.root, r.content is None) for r in read(names="b;c;zz", partitions=2).collect()} == {("b", 0, False), ("c", 1, False), ("zz", None, True)}
    assert [r.name for r in read().where("name in ('a', 'd', 'q')").orderBy("name").collect()] == ["a", "d"]
    (tmp_path / "bucket" / "c.json").write_text("{broken")
    assert read().where("name = 'd'").count() == 1  # the filter is pushed down: the broken object is not opened
    with pytest.raises(Exception, match="BrokenObject"):
        read().collect()
    with pytest.raises(Exception, match="MissingObject"):
        read(names="zz", missing="error").collect()
