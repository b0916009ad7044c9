"""Sliding-window rate limits, in batches and on streams. Refused requests do not count."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.functions.vocab import RATE_LIMITS
from lexmill.sources.scratch import shared_folder
from lexmill.streaming.ordered import InOrder, apply


class Window:
    """The accepted requests of one key within the last seconds."""

    def __init__(self, most: int, seconds: float, accepted=()):
        self.most, self.seconds, self.accepted = most, seconds, deque(accepted)

    def admit(self, at: float) -> bool:
        while self.accepted and self.accepted[0] < at - self.seconds:
            self.accepted.popleft()
        if len(self.accepted) >= self.most:
            return False
        self.accepted.append(at)
        return True


def sessions(rows: DataFrame, seconds: float) -> DataFrame:
    """rows (key, id, at) with session, a number that changes with the key and wherever more than seconds pass.

    The order by (key, at, id) is dealt out in ranges and written, so that no key is one task's; each range looks back
    within itself, and what the ranges before it ended with and how many sessions they began is one row each.
    """
    spark = rows.sparkSession
    path = shared_folder(spark, "sessions")
    rows.orderBy("key", "at", "id").withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    line = spark.read.parquet(path).withColumn("range", F.shiftright("place", 33).cast("int"))
    here = W.partitionBy("range").orderBy("place")
    before = F.lag(F.struct("key", "at")).over(here)
    begins = ~F.coalesce(before["key"].eqNullSafe(F.col("key")) & (F.col("at") - before["at"] <= seconds), F.lit(False))
    marked = line.withColumn("begins", F.when(before.isNull(), F.lit(None)).otherwise(begins))
    ends = marked.groupBy("range").agg(F.min_by(F.struct("key", "at"), "place").alias("first"), F.max_by(F.struct("key", "at"), "place").alias("last"), F.count_if("begins").alias("n"))
    edges, total, last = [], 0, None
    for r in sorted(ends.collect(), key=lambda r: r["range"]):
        goes_on = last is not None and r["first"]["key"] == last["key"] and r["first"]["at"] - last["at"] <= seconds
        total += not goes_on
        edges.append((r["range"], total))
        total, last = total + r["n"], r["last"]
    table = spark.createDataFrame(edges, "range int, base long")
    own = F.sum(F.coalesce(F.col("begins"), F.lit(False)).cast("long")).over(here)
    return marked.withColumn("own", own).join(F.broadcast(table), "range").select("key", "id", "at", (F.col("base") + F.col("own")).alias("session"))


def limit(events: DataFrame, key: str, at: str, order: str, kind: str = "LOGIN", most: int | None = None, seconds: float | None = None) -> DataFrame:
    """(key, order, at, admitted) for every event, in time order within its key.

    Whether a request is admitted depends on those admitted before it, but never on one more than a window ago. So a
    key's requests part wherever they pause for longer than that, and each part is walked by itself, in order, with no
    more than one window of it held: a busy user is as many tasks as there are pauses. Null keys are one key; a request
    without a time comes first and is admitted as if at the beginning of time.
    """
    most, seconds = most or RATE_LIMITS[kind][0], seconds or RATE_LIMITS[kind][1]
    slim = events.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("id"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"))
    parted = sessions(slim.withColumn("at", F.coalesce("at", F.lit(-1e12))), seconds)
    sorted_ = parted.repartition("session").sortWithinPartitions("session", "at", "id")

    def walk(batches):
        import pyarrow as pa

        current, window = None, Window(most, seconds)
        for batch in batches:
            out = []
            for s, t in zip(batch.column("session").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if s != current:
                    current, window = s, Window(most, seconds)
                out.append(window.admit(t))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), batch.column("at"), pa.array(out, pa.bool_())], names=["key", "id", "at", "admitted"])

    done = sorted_.mapInArrow(walk, "key long, id long, at double, admitted boolean")
    return done.withColumn("at", F.when(F.col("at") > -1e12, F.col("at")))


class Admit(InOrder):
    """Admits or refuses the requests of a key; state: when those within the window were admitted."""

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, seconds

    def step(self, state, row):
        window = Window(self.most, self.seconds, state[0] if state else ())
        admitted = window.admit(row[0] / 1e6)
        return (list(window.accepted),), [(row[1], row[0] / 1e6, admitted)]

    def due(self, state, until):
        """Drops what the window has left behind, and the state with it once it is empty."""
        kept = [a for a in state[0] if a >= until / 1e6 - self.seconds] if state else []
        return ((kept,) if kept else None), []

    def next_due(self, state):
        return int((state[0][-1] + self.seconds) * 1e6) + 1000


def limit_stream(events: DataFrame, key: str, at: str, order: str, kind: str = "LOGIN", most: int | None = None, seconds: float | None = None, late: str = "10 minutes") -> DataFrame:
    """(key, id, at, admitted) of a stream, with the answers that limit() gives.

    Requests are held until the watermark has passed them and are then taken in the order of their time, so that one
    that comes late, but not later than late, is answered as if it had come in its place. The state of a key is one
    window, dropped once it is empty. Requests without a key, time or order are left out.
    """
    most, seconds = most or RATE_LIMITS[kind][0], seconds or RATE_LIMITS[kind][1]
    time = F.col(at).cast("timestamp")
    slim = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(time).alias("at"), F.col(order).cast("long").alias("id"), time.alias("_time")).dropna()
    return apply(slim.withWatermark("_time", late), Admit(most, seconds), "key long, id long, at double, admitted boolean")
