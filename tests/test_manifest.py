import os
import signal
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from lexmill.operators.invariants import InvariantBroken
from lexmill.sources import manifest
from lexmill.sources.manifest import Store


def rows(spark, first, n=5, tag="a"):
    return spark.range(first, first + n).select(F.col("id").alias("k"), F.lit(tag).alias("tag"))


def test_two_writers_at_once(spark, tmp_path):
    path, lost = f"file://{tmp_path}/t", []

    def write(tag, base):
        for i in range(4):
            Store(spark, path).publish(f"{tag}{i}", {"f": rows(spark, base + 10 * i, tag=tag), "e": rows(spark, base + 10 * i, 7, tag)}, {"f": ["k"]})
            try:  # both bring these
                Store(spark, path).publish(f"{tag}-both-{i}", {"f": rows(spark, 1000 + 10 * i, tag=tag)}, {"f": ["k"]})
            except InvariantBroken:
                lost.append(i)

    threads = [threading.Thread(target=write, args=a) for a in (("a", 0), ("b", 500))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = Store(spark, path)
    assert sorted(lost) == [0, 1, 2, 3] and store.last() == 12 and [c["version"] for c in store.commits()] == list(range(1, 13))
    got = [r.k for r in store.table("f").collect()]
    assert len(got) == len(set(got)) == 60 and store.table("e").count() == 56
    assert store.sweep(["f", "e"], 0) == []  # the writers that lost left nothing behind


def test_no_half_run(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t")
    store.publish("1", {"f": rows(spark, 0), "e": rows(spark, 0)})
    broken = rows(spark, 10).withColumn("tag", F.when(F.col("k") > 12, F.raise_error(F.lit("torn"))).otherwise("x"))
    with pytest.raises(Exception, match="torn"):
        store.publish("2", {"f": rows(spark, 10), "e": broken})
    with pytest.raises(InvariantBroken):
        store.publish("3", {"f": rows(spark, 20).unionByName(rows(spark, 20))}, {"f": ["k"]})
    assert store.last() == 1 and store.table("f").count() == 5 and store.sweep(["f", "e"], 0) == []
    store.publish("2", {"f": rows(spark, 10), "e": rows(spark, 10)})
    assert store.table("f").count() == 10 and store.table("f", 1).count() == 5 and store.table("none") is None
    assert store.table("f", run="2").count() == 5


KILLED = """
import sys, time
from pyspark.sql import SparkSession, functions as F
from lexmill.sources.manifest import Store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
mark = sys.argv[2]
def hang(batches):
    open(mark, "w").close()
    time.sleep(600)
    yield from batches
Store(spark, sys.argv[1]).publish("killed", {"f": spark.range(3).withColumnRenamed("id", "k"), "e": spark.range(3).mapInArrow(hang, "id long")})
"""


def test_writer_killed_between_tables(spark, tmp_path):
    path, mark = f"file://{tmp_path}/t", f"{tmp_path}/mark"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    writer = subprocess.Popen([sys.executable, "-c", KILLED, path, mark], cwd=root, start_new_session=True, env=os.environ | {"PYTHONPATH": root}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        until = time.time() + 90
        while not os.path.exists(mark) and time.time() < until:
            time.sleep(0.2)
    finally:
        os.killpg(writer.pid, signal.SIGKILL)
        writer.wait()
    store = Store(spark, path)
    assert os.path.exists(mark) and os.listdir(f"{tmp_path}/t/f") and store.last() == 0 and store.table("f") is None
    store.publish("killed", {"f": rows(spark, 0, 3), "e": rows(spark, 0, 3)})
    assert store.table("f").count() == 3 == store.table("e").count()
    assert len(store.sweep(["f", "e"], 0)) == 2 and store.table("f").count() == 3


def test_batches_read_only_what_may_hold_their_keys(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t")
    for i in range(12):
        store.publish(f"r{i}", {"": rows(spark, 10 * i)}, {"": ["k"]}, stored="skip")
    assert store.folders("", key="k", within=(200, 210, False)) == []
    assert len(store.folders("", key="k", within=(31, 33, False))) == 1
    before = store.last()
    store.publish("late", {"": rows(spark, 32, 5)}, {"": ["k"]}, stored="skip")  # 32 to 34 are stored
    assert sorted(r.k for r in store.table("", since=before).collect()) == [35, 36]
    odd = spark.createDataFrame([(None, "n"), (None, "n"), (500, "x")], "k long, tag string")
    for n in range(2):
        store.publish(f"nulls{n}", {"": odd}, {"": ["k"]}, stored="skip")
    assert store.table("").filter("k is null").count() == 1 and store.table("").filter("k = 500").count() == 1
    empty = rows(spark, 0, 0)
    store.publish("empty", {"": empty}, {"": ["k"]}, stored="skip")
    assert store.table("", since=store.last() - 1).count() == 0


def test_long_logs_are_summed_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "SUMMED", 3)
    path = f"file://{tmp_path}/t"
    for i in range(8):
        Store(spark, path).publish(f"r{i}", {"t": rows(spark, i, 1)})
    assert sorted(n for n in os.listdir(f"{tmp_path}/t/_log") if n.endswith(".sum")) == [f"{v:020d}.sum" for v in (3, 6)]
    store, read = Store(spark, path), []
    monkeypatch.setattr(store, "_read", lambda name, own=store._read: read.append(name) or own(name))
    assert [c["run"] for c in store.commits()] == [f"r{i}" for i in range(8)] and len(read) == 3
    assert Store(spark, path).publish("r5", {"t": rows(spark, 99, 1)}) == 6 and Store(spark, path).last() == 8
