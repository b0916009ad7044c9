"""Helpers shared by the training-data operators: table reading, lineage cuts, bounded bitmaps, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker; texts are long, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
#: A key that holds more than this share of a join's rows is hot; there are fewer than its inverse of them.
HOT_SHARE = 1 / 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name below sf_dir."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in the Python workers.

    Results are evaluated lazily, so the setting stays; a session that asks for smaller batches keeps its own.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        held = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; on a
    cluster, whose executors could not see that, it is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
        sc.setCheckpointDir(path)
    return path


class Scratch:
    """Intermediate tables of one operator call, in the folder all executors share.

    ``keep`` writes a frame as Parquet and reads it back, which cuts the lineage: a lost executor costs a reread, not
    the work done so far. ``drop`` deletes tables that are no longer needed; what is left goes when the process ends,
    because a lazily evaluated result may still read it.
    """

    _left: list[tuple[SparkSession, str]] = []
    _tables: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/lexmill-{name}-{uuid.uuid4().hex[:12]}", 0
        Scratch._left.append((spark, self.root))

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lexmill_path = path
        return out

    def bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """As keep, dealt into buckets by a column, so that a join on it leaves the rows where they are."""
        self.n += 1
        name, path = f"lexmill_{uuid.uuid4().hex}", f"{self.root}/t{self.n}"
        df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(name)
        Scratch._tables.append((self.spark, name))
        return self.spark.table(name)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._lexmill_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, name in Scratch._tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001
            pass
    for spark, root in Scratch._left:
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001  the session may have ended before the process
            pass


def whole_row(df: DataFrame) -> Column:
    """All columns of a table as one struct, so that columns worked out beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def numbered(scratch: Scratch, rows: DataFrame, *order: Column, place: str = "place") -> DataFrame:
    """rows with their places in that order, from 0, in a column of type long.

    The order is dealt out in ranges, so that no task holds more than its share, however few the keys; a place is the
    number of rows in the ranges before plus the place in its own. One number a range reaches the driver, that is, as
    many as there are shuffle partitions.
    """
    at = scratch.keep(rows.orderBy(*order).withColumn(place, F.monotonically_increasing_id()))
    held = at.groupBy(F.shiftright(place, 33).cast("int").alias("k")).count().collect()
    before, total = [], 0
    for r in sorted(held, key=lambda r: r["k"]):
        before.append((r["k"], total))
        total += r["count"]
    starts = rows.sparkSession.createDataFrame(before, "lexmill_range int, lexmill_before long")
    joined = at.join(F.broadcast(starts), F.shiftright(place, 33).cast("int") == F.col("lexmill_range"))
    return joined.select(*rows.columns, (F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("lexmill_before")).alias(place))


def spread_join(many: DataFrame, one: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """many left-joined to one on a column of that name, nulls equal; a key stands at most once in one.

    Keys that hold more than HOT_SHARE of many are fewer than 1 / HOT_SHARE, so their rows of one are broadcast and
    their rows of many stay where they are; all others are shuffled, and none of them can fill a task.
    """
    rows, rest = scratch.keep(many), [c for c in one.columns if c != key]
    counts = rows.groupBy(key).count()
    least = rows.count() * HOT_SHARE
    hot = counts.filter(F.col("count") > least).select(F.col(key).alias("_hot"), F.lit(True).alias("_is_hot"))
    o = one.withColumnRenamed(key, "_one")
    few = scratch.keep(hot.join(o, F.col("_hot").eqNullSafe(F.col("_one")), "left").drop("_one"))
    marked = rows.join(F.broadcast(few), F.col(key).eqNullSafe(F.col("_hot")), "left")
    near = marked.filter("_is_hot").select(*many.columns, *rest)
    far = marked.filter("_is_hot is null").select(*many.columns)
    return near.unionByName(far.join(o, F.col(key).eqNullSafe(F.col("_one")), "left").select(*many.columns, *rest))


def either(df: DataFrame, column: str, kind: str) -> Column:
    """The column, or a null of that kind where the table lacks it."""
    return F.col(column).cast(kind) if column in df.columns else F.lit(None).cast(kind)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply) on unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Bitmap:
    """A one-hash Bloom filter of fixed size over long ids: a bounded constant that thins a scan before a join.

    It may let through ids that are not in the set, never the reverse; the join that follows is exact. Its size does
    not grow with the data (``bits`` / 8 bytes), so it may be sent to every task; with more ids than bits it only
    thins less.
    """

    def __init__(self, ids: DataFrame, column: str, bits: int = 1 << 23):
        self.spark, self.bits = ids.sparkSession, bits
        rows = (
            ids.select(self._slot(F.col(column)).alias("s"))
            .groupBy(F.shiftright("s", 6).cast("int").alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("v"))
        )
        got = rows.toPandas()
        words = np.zeros(bits // 64, dtype=np.int64)
        words[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
        self.words = pa.table({"words": pa.array([words], pa.list_(pa.int64()))})

    def _slot(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.bits))

    def maybe(self, column: str) -> Column:
        """Whether the id may be in the set, inside the JVM."""
        words, slot = self.spark.createDataFrame(self.words).scalar(), self._slot(F.col(column))
        word = F.get(words, F.shiftright(slot, 6).cast("int"))
        return F.call_function("getbit", word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ids; only rows that a bitmap cannot clear are moved for it."""
    gone = Bitmap(ids, "doc_id")
    doubtful = docs.filter(gone.maybe("doc_id") & F.col("doc_id").isNotNull()).join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
    return docs.filter(~gone.maybe("doc_id") | F.col("doc_id").isNull()).unionByName(doubtful.select(*docs.columns))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long: (id, component) with component the smallest id reachable.

    Each round takes every node's smallest neighbour label, hands it to the node that the old label names, and then
    jumps every label to the label of the node it names, so that chains shorten geometrically whatever the order of
    their ids. Labels only ever fall, so the rounds end by themselves, when none changes; each is written out, and
    nothing but a change count reaches the driver.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("lb")), "b").groupBy(F.col("a").alias("id")).agg(F.min("lb").alias("m"))
        low = scratch.keep(labels.join(near, "id", "left").select("id", "component", F.least("component", "m").alias("low")))
        # The node that a label names also learns of the smaller label (hooking), then labels jump.
        hooks = low.groupBy(F.col("component").alias("id")).agg(F.min("low").alias("rl"))
        hooked = scratch.keep(low.join(hooks, "id", "left").select("id", "component", F.least("low", "rl").alias("low")))
        named = hooked.select(F.col("id").alias("r"), F.col("low").alias("jump"))
        after = scratch.keep(hooked.join(named, hooked["low"] == named["r"]).select("id", F.col("component").alias("was"), F.col("jump").alias("component")))
        changed = after.filter("was <> component").limit(1).count()
        scratch.drop(labels, low, hooked)
        labels = after.select("id", "component")
        labels._lexmill_path = after._lexmill_path
        if not changed:
            scratch.drop(both)
            return labels
