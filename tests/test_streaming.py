import random

from pyspark.sql import functions as F

from lexmill.plans.fixtures import CORPUS_RULES
from lexmill.streaming import analyze, rate_limit


def test_sliding_window_against_model(spark):
    rng = random.Random(3)
    rows = sorted((rng.randint(0, 3), i, rng.randint(0, 400)) for i in range(300))
    df = spark.createDataFrame(rows, "k long, i long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.key, r.id): r.admitted for r in rate_limit.limit(df, "k", "ts", "i", most=4, seconds=60).collect()}
    for key in range(4):
        held = []
        for _, i, s in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            held = [h for h in held if h >= s - 60]
            assert got[(key, i)] == (len(held) < 4)
            if len(held) < 4:
                held.append(s)


def test_replayed_stream_equals_batch(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(["Released under the MIT License.\nx", "All rights reserved.", "of the and that in the", "plain"] * 5)]
    schema = "doc_id long, text string"
    spark.createDataFrame(docs[:12], schema).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame(docs[12:], schema).write.mode("append").parquet(f"{tmp_path}/in")
    for n in ("one", "two"):  # the second run sees every document again
        q = analyze.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), CORPUS_RULES, f"{tmp_path}/out", f"{tmp_path}/{n}")
        assert q.awaitTermination(60)
    cols = ["doc_id", "requirement", "state", "best", "qualifying"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*cols).collect()))
    want = sorted(map(tuple, analyze.map_batch(spark.createDataFrame(docs, schema), CORPUS_RULES).select(*cols).collect()))
    assert got == want


def test_audit_feed_and_versions(spark, tmp_path):
    rows = [(1, s, "login") for s in range(0, 24, 2)] + [(2, 5, "export")]
    df = spark.createDataFrame(rows, "user_id long, s long, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    df.select("user_id", "ts", "event_type").coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(f"{tmp_path}/ev")
    q = analyze.audit_feed(stream, "ts").writeStream.format("memory").queryName("feed").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {(r.event_type, r.n) for r in spark.table("feed").collect()} == {("login", 12), ("export", 1)}
    m = spark.createDataFrame([("a", None), ("b", "v1"), ("c", "v2")], "id string, fingerprint string")
    assert {r.id for r in analyze.same_version(m, "v1").collect()} == {"a", "b"}


def test_messages_about_state_do_not_grow_with_the_keys():
    """A group of keys is handled by as many calls on its state and timers, however many keys it has."""
    import pandas as pd

    calls = []

    class Kept(list):
        def get(self):
            calls.append("get")
            return iter(list(self))

        def put(self, rows):
            calls.append("put")
            self[:] = rows

        def appendList(self, rows):
            calls.append("append")
            self.extend(rows)

        def clear(self):
            calls.append("clear")
            del self[:]

    class Handle:
        def getListState(self, name, schema):
            return Kept()

        def registerTimer(self, at):
            calls.append("timer")

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    counts = []
    for n in (3, 300):
        admit = rate_limit.Admit(most=1, seconds=10)
        admit.columns = ["key", "id", "at", "admitted"]
        admit.init(Handle())
        del calls[:]
        rows = pd.DataFrame([(k, s * 1_000_000, k * 10 + s) for k in range(n) for s in (2, 1)], columns=["key", "at", "id"])
        assert list(admit.handleInputRows((0,), iter([rows]), None)) == []
        (out,) = admit.handleExpiredTimer((0,), At(5000), At(5000))
        assert sorted(out.itertuples(index=False, name=None)) == [(k, k * 10 + s, float(s), s == 1) for k in range(n) for s in (1, 2)]
        counts.append(len(calls))
    assert counts[0] == counts[1] < 20


def test_only_the_first_timer_of_a_group_reads_and_writes_its_states():
    """Rows that come in many frames are one timer, and a timer that finds nothing due leaves the states alone."""
    import pandas as pd

    calls, timers = [], []

    class Kept(list):
        def __init__(self, name):
            self.name = name

        def get(self):
            calls.append((self.name, "get"))
            return iter(list(self))

        def put(self, rows):
            calls.append((self.name, "put"))
            self[:] = rows

        def appendList(self, rows):
            self.extend(rows)

        def clear(self):
            del self[:]

    class Handle:
        def getListState(self, name, schema):
            return Kept(name)

        def registerTimer(self, at):
            timers.append(at)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    admit = rate_limit.Admit(most=1, seconds=10)
    admit.columns = ["key", "id", "at", "admitted"]
    admit.init(Handle())
    frames = [pd.DataFrame([(k, s * 1_000_000, k) for k in range(50)], columns=["key", "at", "id"]) for s in range(1, 9)]
    assert list(admit.handleInputRows((0,), iter(frames), None)) == [] and timers == [1000]
    assert len(admit.waiting) == len(frames)
    (out,) = admit.handleExpiredTimer((0,), At(8000), At(8000))
    assert len(out) == 400 and out["admitted"].sum() == 50
    before = list(admit.held)
    del calls[:]
    assert list(admit.handleExpiredTimer((0,), At(8000), At(8000))) == []
    assert not [c for c in calls if c[0] in ("waiting", "held")] and list(admit.held) == before
