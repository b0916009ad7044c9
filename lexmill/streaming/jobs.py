"""Jobs on streams: failed attempts that are sent again after a while, and jobs that never came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.operators.ingest import ERROR_DELAY, SKEW_DELAY
from lexmill.streaming.ordered import InOrder, apply

#: How often a job is sent again at most, and after how many seconds, by what became of it.
RETRIES = 5
DELAYS = {"SKEW": SKEW_DELAY, "ERROR": ERROR_DELAY}
SENT = "key long, attempt int, due long, action string"


class Retry(InOrder):
    """Sends a job again when its delay is over, unless another report of it came first; state: failures, due, over."""

    fields = "at long, id long, outcome string"

    def step(self, state, row):
        at, _, outcome = row
        failures, _, over = state or (0, None, False)
        if over or outcome not in DELAYS:
            return (failures, None, True), []
        failures += 1
        if failures > RETRIES:
            return (failures, None, True), [(failures, at, "GIVE_UP")]
        return (failures, at + DELAYS[outcome] * 1_000_000, False), []

    def due(self, state, until):
        if state and state[1] is not None and state[1] <= until:
            return (state[0], None, state[2]), [(state[0], state[1], "SEND")]
        return state, []

    def next_due(self, state):
        return state[1]


def _reports(reports: DataFrame, job: str, at: str, order: str, outcome: Column) -> DataFrame:
    return reports.select(F.col(job).cast("long").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(order).cast("long").alias("id"), outcome.alias("outcome"), F.col(at).cast("timestamp").alias("_time"))


def retry_stream(reports: DataFrame, job: str, at: str, order: str, outcome: Column, late: str = "10 minutes") -> DataFrame:
    """(key, attempt, due, action) of a stream of reports, each what became of one attempt of a job.

    SKEW and ERROR have the job sent again once its delay is over, at due (microseconds); any other outcome ends it, and
    so does the failure after the last retry, which is a GIVE_UP. A report that comes before a retry is due takes its
    place. Timers run on event time, reports count in its order, and those later than late are dropped. A report
    without a time, job or order is no report.
    """
    rows = _reports(reports, job, at, order, outcome).dropna(subset=["key", "at", "id"]).withWatermark("_time", late)
    return apply(rows, Retry(), SENT)


def retry_plan(reports: DataFrame, job: str, at: str, order: str, outcome: Column) -> DataFrame:
    """As retry_stream, of reports that are all at hand.

    A job's end is one aggregate, and of its failures before that only the first few are kept, by every task of its own
    rows already: no job is more than that many rows after the shuffle, however often it was reported.
    """
    rows = _reports(reports, job, at, order, outcome).dropna(subset=["key", "at", "id"]).drop("_time")
    failed = F.coalesce(F.col("outcome").isin(*DELAYS), F.lit(False))
    end = rows.filter(~failed).groupBy("key").agg(F.min(F.struct("at", "id")).alias("end"))
    by_time = W.partitionBy("key").orderBy("at", "id")
    first = rows.filter(failed).withColumn("attempt", F.row_number().over(by_time)).filter(F.col("attempt") <= RETRIES + 1)
    own = first.join(end, "key", "left").filter(F.col("end").isNull() | (F.struct("at", "id") < F.col("end")))
    own = own.withColumn("next", F.least(F.lead("at").over(by_time), F.col("end.at")))
    delay = F.create_map(*[F.lit(v) for pair in DELAYS.items() for v in pair])[F.col("outcome")]
    due = F.when(F.col("attempt") <= RETRIES, F.col("at") + delay.cast("long") * 1_000_000).otherwise(F.col("at"))
    action = F.when(F.col("attempt") > RETRIES, "GIVE_UP").when(F.col("next").isNull() | (due <= F.col("next")), "SEND")
    return own.select("key", F.col("attempt").cast("int").alias("attempt"), due.alias("due"), action.alias("action")).filter("action is not null")


def lost_jobs(sent: DataFrame, done: DataFrame, job: str, at: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The rows of sent that no row of done with the same job follows within that time, each once.

    Both are streams, or both tables. On streams state is held until the watermark has passed the end of that time; a
    completion at the very moment counts, and so does one at its very end.
    """
    s, d = (sent, done) if not sent.isStreaming else (sent.withWatermark(at, late), done.withWatermark(at, late))
    d = d.select(F.col(job).alias("_job"), F.col(at).alias("_at"))
    on = (F.col(job) == F.col("_job")) & (F.col("_at") >= F.col(at)) & (F.col("_at") <= F.col(at) + F.expr(f"interval {within}"))
    if not sent.isStreaming:
        return s.join(d, on, "left_anti")
    return s.join(d, on, "left_outer").filter("_job is null").drop("_job", "_at")
