import random

from pyspark.sql import functions as F

from lexmill.operators import append_only
from lexmill.sources import sinks
from lexmill.sources.manifest import Store


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, a string, b double").repartition(4)


def test_departures(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["x", "y", None, "1:x", ""]), rng.choice([1.0, None])) for i in range(3000)] + [(None, "n", 1.0), (5000, "twice", 1.0), (5000, "twice", 1.0)]
    old = frame(spark, rows)
    assert append_only.departures(old, frame(spark, rows[::-1]), ["k"]).collect() == []
    odd = [r for r in rows if r[0] not in (7, 2900)]
    odd = [(k, "other", b) if k == 100 else (k, a, b) for k, a, b in odd]
    odd.remove((5000, "twice", 1.0))
    odd += [(9999, "late", None)]
    got = sorted((str(r.k), r.verdict) for r in append_only.departures(old, frame(spark, odd).withColumn("more", F.lit(1)), ["k"], append_only.tree(old, ["k"])).collect())
    assert got == sorted([("7", "lost"), ("2900", "lost"), ("100", "changed"), ("5000", "changed"), ("9999", "backdated")])
    empty = old.limit(0)
    assert {r.verdict for r in append_only.departures(old.limit(5), empty, ["k"]).collect()} == {"lost"}
    assert append_only.departures(empty, empty, ["k"]).collect() == []


def test_only_branches_that_differ_are_descended(spark):
    rows = [(i, "x", 1.0) for i in range(20_000)]
    a = append_only.tree(frame(spark, rows), ["k"])
    b = append_only.tree(frame(spark, [(k, "y" if k == 77 else x, v) for k, x, v in rows]), ["k"])
    assert [len(level) for level in append_only.differing(a, b)] == [1] * (append_only.LEVELS + 1)
    assert [len(level) for level in append_only.differing(a, a)] == [0] * (append_only.LEVELS + 1)
    root = a.filter("level = 0").collect()
    assert len(root) == 1 and root[0].n == 20_000 and a.filter("level = 1").count() == append_only.FANOUT


def test_stored_objects_are_not_written_again(spark, tmp_path, monkeypatch):
    """Only objects that the store lacks are staged, each once, in the order of their keys."""
    staged, stage = [], Store._stage
    monkeypatch.setattr(Store, "_stage", lambda *a, **k: staged.append(stage(*a, **k)) or staged[-1])
    files = spark.createDataFrame([(f"f{i % 2}.pdf", f"text {i % 40}".encode()) for i in range(100)], "name string, content binary")
    path = f"file://{tmp_path}/o"
    for part in (files.filter("name = 'f0.pdf'").limit(20), files, files, files.limit(0), files.limit(1)):
        sinks.put_objects(part, path)
    assert [s["rows"] for s in staged] == [20, 20, 0, 0, 0]
    got = sinks.stored_objects(spark, path)
    assert got.columns == ["name", "content", "storage_key"] and got.count() == 40
    assert {(bytes(r.content), r.storage_key) for r in got.collect()} == {(bytes(r.content), r.storage_key) for r in files.withColumn("storage_key", sinks.object_key(F.col("content"), F.col("name"))).collect()}
    for s in staged[:2]:
        keys = [r.storage_key for r in spark.read.parquet(f"{path}/{s['folder']}").coalesce(1).collect()]
        assert keys == sorted(set(keys))


def test_objects_are_looked_up_by_key(spark, tmp_path, monkeypatch):
    files = spark.range(500).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".pdf")).alias("name"), F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("content"))
    path = f"file://{tmp_path}/o"
    sinks.put_objects(files.limit(0), path)
    assert sinks.stored_objects(spark, f"file://{tmp_path}/none", files.select(F.lit("a/b").alias("storage_key"))).collect() == []
    for _ in range(2):
        sinks.put_objects(files, path)
    keys = files.select(sinks.object_key(F.col("content"), F.col("name")).alias("storage_key"))
    few = keys.limit(3).unionByName(spark.createDataFrame([("zz/none",), (None,)], "storage_key string"))
    found = sinks.stored_objects(spark, path, few, content=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3 and "In(storage_key" in plan and "content" not in plan.split("ReadSchema")[1]
    assert sinks.stored_objects(spark, path, keys).count() == 500
    monkeypatch.setattr(sinks, "KEYS_AT_HAND", 2)
    assert {bytes(r.content) for r in sinks.stored_objects(spark, path, few).collect()} <= {bytes(r.content) for r in files.collect()}
    assert sinks.stored_objects(spark, path, few).count() == 3
