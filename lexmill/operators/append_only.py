"""Proof that a table was only appended to: trees of digests of two snapshots, compared from the root down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.scratch import shared_folder

#: A node has so many children, and leaves lie so many levels below the root.
FANOUT, LEVELS = 16, 4


def _row(columns: list[str]) -> Column:
    """A text in which every value stands with its length, so that no two rows of different values share it."""
    told = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*[told(F.col(f"`{c}`").cast("string")) for c in columns])


def leaf(keys: list[str]) -> Column:
    """The leaf of a row, by its key alone, so that a changed row stays where it was."""
    return F.pmod(F.xxhash64(_row(keys)), F.lit(FANOUT**LEVELS)).cast("int")


def tree(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(level, node, n, digest): the digests of all nodes that hold rows, the root at level 0.

    A leaf's digest is over the sum of its rows' digests, so that it depends on no order and counts repeated rows; a
    node's is over those of its children. One aggregate with a partial step; what it puts out is bounded by the number
    of leaves. It is written to the shared folder, level by level: what a snapshot keeps, to be held against later.
    """
    whole = sorted(rows.columns)
    digest = F.sha2(_row(whole).cast("binary"), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    level = rows.groupBy(leaf(keys).alias("node")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", *[part(i).cast("string") for i in range(4)]), 256).alias("digest"))
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "tree")
    level.write.parquet(f"{path}/level={LEVELS}")
    for depth in range(LEVELS - 1, -1, -1):
        below = spark.read.parquet(f"{path}/level={depth + 1}")
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        level = below.groupBy(F.expr(f"node div {FANOUT}").cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.to_json(children), 256).alias("digest"))
        level.coalesce(1).write.parquet(f"{path}/level={depth}")
    return spark.read.parquet(path)


def differing(old: DataFrame, new: DataFrame) -> list[list[int]]:
    """For each level from the root down, the nodes whose digests differ between two trees; there are no more than leaves.

    Below a node that is the same in both nothing is compared: a level holds the children of the nodes above that
    differ, and no others.
    """
    out: list[list[int]] = []
    for depth in range(LEVELS + 1):
        a, b = (t.filter(F.col("level") == depth).select("node", F.col("digest").alias(n)) for t, n in ((old, "a"), (new, "b")))
        if depth:
            inside = F.expr(f"node div {FANOUT}").isin(out[-1]) if len(out[-1]) <= FANOUT**2 else F.lit(True)
            a, b = a.filter(inside), b.filter(inside)
        level = a.join(b, "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        out.append(sorted(r["node"] for r in level.collect()))
        if not out[-1]:
            return out + [[]] * (LEVELS - depth)
    return out


def departures(old: DataFrame, new: DataFrame, keys: list[str], old_tree: DataFrame | None = None) -> DataFrame:
    """(keys, verdict) of what new lacks of old: lost (the key is gone), changed (the key is there with other values) or
    backdated (a row of new that should have been in old).

    new is to be cut to what was there when old was taken, by a time or a commit; rows after that are what appending is.
    old_tree is the tree that was kept with old. Rows are read again only where leaves differ, FANOUT ** LEVELS of them
    at most, which travel as a bounded list; equal tables move none. Null keys are keys, repeated rows count: a row that
    lost a copy is changed. Tables of other columns than old's are compared by old's.
    """
    new = new.select(*[f"`{c}`" for c in old.columns])
    apart = differing(old_tree if old_tree is not None else tree(old, keys), tree(new, keys))[-1]
    leaves = F.broadcast(old.sparkSession.createDataFrame([(n,) for n in apart], "node int"))
    sides = []
    for rows, name in ((old, "a"), (new, "b")):
        near = rows.withColumn("_leaf", leaf(keys)).join(leaves, F.col("_leaf") == F.col("node"), "left_semi")
        shown = F.sort_array(F.collect_list(_row(sorted(old.columns))))
        sides.append(near.groupBy(*keys).agg(shown.alias(name)))
    a, b = sides[0].alias("x"), sides[1].alias("y")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`{k}`"))
    both = a.join(b, on, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    verdict = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "backdated").otherwise("changed")
    return both.select(*[F.coalesce(F.col(f"x.`{k}`"), F.col(f"y.`{k}`")).alias(k) for k in keys], verdict.alias("verdict"))
