"""Queries that run streams to their end over the events and read what they put out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.plans.registry import query, table
from lexmill.sources.scratch import shared_folder
from lexmill.streaming import jobs, rate_limit
from lexmill.streaming.ordered import GROUPS

_OUTCOME = "CASE event_type WHEN 'view' THEN 'SKEW' WHEN 'click' THEN 'ERROR' WHEN 'error' THEN 'ERROR' ELSE 'DONE' END"
#: Users come back for days, jobs do not: a job is what a user does in six hours.
_JOB = "user_id * 100000 + CAST(floor(epoch(ts) / 21600) AS BIGINT) % 100000"
_RETRIES = f"""r AS (SELECT {_JOB} AS job, epoch_us(ts) AS t, event_id AS id, {_OUTCOME} AS outcome FROM events),
over_ AS (SELECT job, min(row(t, id)) AS e FROM r WHERE outcome = 'DONE' GROUP BY job),
f AS (SELECT r.*, row_number() OVER w AS attempt, lead(t) OVER w AS then_, e FROM r LEFT JOIN over_ USING (job) WHERE outcome <> 'DONE' AND (e IS NULL OR row(t, id) < e) WINDOW w AS (PARTITION BY job ORDER BY t, id)),
d AS (SELECT job, attempt, CASE WHEN attempt > 5 THEN t ELSE t + CASE outcome WHEN 'SKEW' THEN 60000000 ELSE 10000000 END END AS due, least(then_, struct_extract(e, 1)) AS next_ FROM f WHERE attempt <= 6)
SELECT job AS key, CAST(attempt AS INTEGER) AS attempt, due, CASE WHEN attempt > 5 THEN 'GIVE_UP' ELSE 'SEND' END AS action FROM d WHERE attempt > 5 OR next_ IS NULL OR due <= next_"""


def events(spark, d):
    """The events with their times as instants: those of the table have no zone, and stand for UTC whatever the session's."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, d, "events").withColumn("ts", F.timestamp_micros(micros))


def reports(spark, d):
    e = events(spark, d)
    job = F.col("user_id") * 100000 + F.floor(F.unix_micros("ts") / 21_600_000_000) % 100000
    return e.select(job.cast("long").alias("job"), "ts", "event_id", F.when(F.col("event_type") == "view", "SKEW").when(F.col("event_type").isin("click", "error"), "ERROR").otherwise("DONE").alias("outcome"))


def streamed(spark, rows, at: str, make, name: str, most: int | None = None):
    """make(stream) run over rows that are dealt out in files, and over one row long after them, which moves the watermark
    past all of them; what it put out. most: parts of the state at most, each of which is opened in every batch."""
    path = shared_folder(spark, name)
    rows.repartitionByRange(4, at).write.parquet(f"{path}/in")
    end = rows.agg(F.max(at)).first()[0]
    if end is None:
        return make(rows)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    odd = {c: F.lit(None).cast(k) for c, k in rows.dtypes}

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        made = make(stream)
        try:
            spark.conf.set("spark.sql.shuffle.partitions", min(int(parts), most or int(parts)))
            going = made.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
        going.awaitTermination()
        return made.schema

    schema = run()
    for days in (400, 800):
        after = spark.range(1).select(*[(F.lit(end) + F.expr(f"interval {days} days") if c == at else F.lit(-1).cast(k) if k == "bigint" else odd[c]).alias(c) for c, k in rows.dtypes])
        after.coalesce(1).write.mode("append").parquet(f"{path}/in")
        run()
    return spark.read.schema(schema).parquet(f"{path}/out")


@query("job_retry_plan", f"WITH {_RETRIES}", ids="R3")
def job_retry_plan(spark, d):
    return jobs.retry_plan(reports(spark, d), "job", "ts", "event_id", F.col("outcome"))


@query("job_retry_stream", f"WITH {_RETRIES}", ids="R3 R4")
def job_retry_stream(spark, d):
    """The same rows, put out by timers on event time."""
    out = streamed(spark, reports(spark, d), "ts", lambda s: jobs.retry_stream(s, "job", "ts", "event_id", F.col("outcome")), "retries", GROUPS // 2)
    return out.filter("key <> -1")


_LOST = """SELECT event_id, user_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'purchase' AND d.user_id = e.user_id AND d.ts >= e.ts AND d.ts <= e.ts + INTERVAL 1 HOUR)"""


def _lost(rows):
    sent, done = rows.filter("event_type = 'click' or event_id = -1"), rows.filter("event_type = 'purchase' or event_id = -1")
    return jobs.lost_jobs(sent.select("event_id", "user_id", "ts"), done.select("user_id", "ts"), "user_id", "ts").select("event_id", "user_id")


@query("jobs_lost", _LOST, ids="A17 R6")
def jobs_lost(spark, d):
    return _lost(events(spark, d))


@query("jobs_lost_stream", _LOST, ids="A17 R6")
def jobs_lost_stream(spark, d):
    """Dispatches and completions as two streams; what is lost is named once, when its time has passed."""
    rows = events(spark, d).select("event_id", "user_id", "ts", "event_type")
    return streamed(spark, rows, "ts", _lost, "lost").filter("event_id <> -1")


@query("rate_limit_stream", ids="R5 W13")
def rate_limit_stream(spark, d):
    """As rate_limit_sliding, on a stream; tests hold both against each other."""
    rows = events(spark, d).select("event_id", "user_id", "ts")
    out = streamed(spark, rows, "ts", lambda s: rate_limit.limit_stream(s, "user_id", "ts", "event_id", most=3, seconds=86400.0 * 2), "limits", GROUPS // 2)
    return out.filter("id <> -1")
