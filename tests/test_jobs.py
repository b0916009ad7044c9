import random

from pyspark.sql import functions as F

from lexmill.plans.q_streams import streamed
from lexmill.streaming import jobs, rate_limit

REPORTS = "job long, s double, i long, outcome string"


def made(seed=1, n=500):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, *range(2, 60)]), float(rng.choice([0, 5, 10, 30, 60, 61, 200])) + rng.randint(0, 400), i, rng.choices(["ERROR", "SKEW", "DONE", "REFUSED", None], [8, 6, 2, 1, 1])[0]) for i in range(n)]
    return [r for r in rows if not (r[0] == 1 and r[3] not in ("ERROR", "SKEW"))]


def model(rows):
    """One job after the other, one report after the other."""
    out = []
    for job in {r[0] for r in rows}:
        failures, due = 0, None
        for _, s, _, outcome in sorted((r for r in rows if r[0] == job), key=lambda r: (r[1], r[2])):
            if due is not None and due <= s:
                out.append((job, failures, due, "SEND"))
                due = None
            if outcome not in jobs.DELAYS:
                due = None
                break
            failures += 1
            if failures > 5:
                out.append((job, failures, s, "GIVE_UP"))
                due = None
                break
            due = s + jobs.DELAYS[outcome]
        if due is not None:
            out.append((job, failures, due, "SEND"))
    return sorted(out)


def got(df):
    return sorted((r.key, r.attempt, r.due / 1e6, r.action) for r in df.collect() if r.key != -1)


def test_retries_against_model(spark):
    rows = made()
    df = spark.createDataFrame(rows, REPORTS).withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    want = model(rows)
    assert {w[3] for w in want} == {"SEND", "GIVE_UP"} and len(want) > 100
    assert got(jobs.retry_plan(df, "job", "ts", "i", F.col("outcome"))) == want
    slim = df.select("job", "ts", "i", "outcome")
    assert got(streamed(spark, slim, "ts", lambda s: jobs.retry_stream(s, "job", "ts", "i", F.col("outcome")), "t")) == want
    odd = spark.createDataFrame([(None, 1.0, 1, "ERROR"), (1, None, 2, "ERROR"), (2, 1.0, None, "ERROR")], REPORTS).withColumn("ts", F.timestamp_seconds("s"))
    assert jobs.retry_plan(odd, "job", "ts", "i", F.col("outcome")).collect() == []


def test_lost_jobs_stream_and_table(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 30), rng.choice(["sent", "done"]), float(rng.randint(0, 9000))) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, kind string, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    part = lambda d: jobs.lost_jobs(d.filter("kind = 'sent' or event_id = -1").drop("kind"), d.filter("kind = 'done' or event_id = -1").drop("kind"), "user_id", "ts", "10 minutes")
    want = sorted(i for i, u, k, s in rows if k == "sent" and not any(u == v and m == "done" and s <= t <= s + 600 for _, v, m, t in rows))
    assert sorted(r.event_id for r in part(df).collect()) == want and want
    out = [r.event_id for r in streamed(spark, df, "ts", part, "t").collect() if r.event_id != -1]
    assert sorted(out) == want


def brute(rows, most, seconds):
    out = {}
    for key in {k for k, _, _ in rows}:
        held = []
        for _, i, s in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            held = [h for h in held if h >= s - seconds]
            out[i] = len(held) < most
            if out[i]:
                held.append(s)
    return out


def test_busy_key_is_many_tasks_and_answers_are_exact(spark):
    rng = random.Random(5)
    times, t = [], 0
    for _ in range(900):
        t += rng.choice([0, 1, 3, 60, 61, 200])
        times.append(t)
    rows = [(7 if i % 3 else rng.randint(0, 4), i, s) for i, s in enumerate(times)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(6)
    want = brute(rows, 3, 60)
    got = {r.id: r.admitted for r in rate_limit.limit(df, "k", "ts", "i", most=3, seconds=60).collect()}
    assert got == want and set(want.values()) == {True, False}
    slim = df.select(F.col("k").alias("key"), F.col("i").alias("id"), F.col("s").cast("double").alias("at"))
    parts = rate_limit.sessions(slim, 60).collect()
    assert len({p.session for p in parts if p.key == 7}) > 50
    for key in {p.key for p in parts}:
        own = sorted((p.at, p.id, p.session) for p in parts if p.key == key)
        assert all((a[2] == b[2]) == (b[0] - a[0] <= 60) for a, b in zip(own, own[1:], strict=False))
    out = streamed(spark, df.select("k", "ts", "i"), "ts", lambda s: rate_limit.limit_stream(s, "k", "ts", "i", most=3, seconds=60), "t")
    assert {r.id: r.admitted for r in out.collect() if r.id != -1} == want


def test_late_requests_take_their_place(spark, tmp_path):
    """Batches out of order, within the watermark's patience, are answered as in order."""
    schema = "k long, i long, s long"
    batches = [[(1, 1, 100), (1, 2, 130)], [(1, 3, 90), (1, 4, 131)], [(1, 5, 132), (2, 6, 95)], [(9, -1, 10_000)], [(9, -2, 20_000)]]
    at = f"{tmp_path}/in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema("k long, i long, s long, ts timestamp").parquet(at)
        q = rate_limit.limit_stream(stream, "k", "ts", "i", most=2, seconds=60).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert q.awaitTermination(60) and n < len(batches)
    rows = [r for b in batches for r in b if r[1] > 0]
    assert {r.id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.id > 0} == brute(rows, 2, 60)


def test_rate_limit_odd_rows(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 2, 5), (1, 3, None), (1, 4, None)], "k long, i long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.at, r.admitted) for r in rate_limit.limit(df, "k", "ts", "i", most=1, seconds=60).collect()}
    assert got == {1: (None, True), 2: (5.0, True), 3: (None, True), 4: (None, False)}
    assert rate_limit.limit(df.limit(0), "k", "ts", "i", most=1, seconds=60).collect() == []
