"""Approximate nearest neighbours by a hash-prefix forest: sorted arrays of long hash strings, one per tree.

A query descends each tree to its longest prefix match and then ascends all trees together, one bit at a time, until
the ranges below it hold enough rows. A range of a sorted array is what a subtree would hold, so that a tree is nothing
but an array that is cut into blocks of neighbouring codes; the rows of a block and the queries whose range touches it
meet in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm.common import Scratch, mix64, read, tune

#: Trees, bits of a hash string, rows of a block and queries that one task holds against them.
TREES, BITS, BLOCK = 24, 40, 16384
#: Bound of the sample that sets the mean, the blocks, the estimates of how many rows share a prefix, and the reach.
SAMPLE = 8192
#: The reach is the number of rows that all ranges of a query hold together, as a share of all rows. The least of these
#: whose recall over the sample, for TRIALS of its rows, is RECALL; in a larger table the nearest rows are nearer and
#: are found more surely. Vectors without any structure need about as many rows as there are, clustered ones far fewer.
REACHES, TRIALS, RECALL = tuple(2.0 ** (k / 2) for k in range(-14, 7)), 256, 0.95
NEAREST, EVERY = 20, 20


class Forest:
    """Hash functions, block bounds and sorted sample codes; a few MB whatever the size of the table."""

    def __init__(self, sample: np.ndarray, mean: np.ndarray, norm: float, total: int, asked: int, trees: int, reach: float | None, nearest: int, seed: int = 11):
        """norm: the greatest distance of a row from mean; total and asked: numbers of rows and of queries."""
        d = sample.shape[1]
        self.trees, self.mean, self.norm = trees, mean, norm
        self.planes = np.random.default_rng(seed).standard_normal((d + 1, trees * BITS))
        own = self.codes(sample, False)
        codes = np.sort(own, axis=0)
        self.sorted = [np.ascontiguousarray(codes[:, t]) for t in range(trees)]
        least = 4.0 * nearest * len(sample) / max(total, 1)
        self.reach = self.tuned(sample, own, nearest) if reach is None else reach
        self.enough = min(1.0 * len(sample) * trees, max(self.reach * len(sample), least))
        blocks = max(1, -(-total // BLOCK))
        self.bounds, self.parts, self.asked = [], [], []
        low, high = self.ranges(self.codes(sample, True))
        for t, s in enumerate(self.sorted):
            cuts = np.unique(s[(np.arange(1, blocks) * len(s)) // blocks]) if len(s) else np.zeros(0, np.int64)
            self.bounds.append(cuts)
            held = np.bincount(np.searchsorted(cuts, s, side="right"), minlength=len(cuts) + 1) * (total / max(len(s), 1))
            # Where very many rows share a code, no bound can part them; such blocks are dealt out by id.
            self.parts.append(np.maximum(1, np.ceil(held / (2 * BLOCK)).astype(np.int64)))
            # Likewise the queries: the sample's rows stand for them.
            a, b = np.searchsorted(cuts, low[:, t], side="right"), np.searchsorted(cuts, high[:, t], side="right")
            met = np.cumsum(np.bincount(a, minlength=len(cuts) + 2) - np.bincount(b + 1, minlength=len(cuts) + 2))[: len(cuts) + 1]
            self.asked.append(np.maximum(1, np.ceil(met * (asked / max(len(s), 1)) / (2 * BLOCK)).astype(np.int64)))

    def tuned(self, sample: np.ndarray, codes: np.ndarray, nearest: int) -> float:
        """The least reach that finds RECALL of the nearest rows of TRIALS rows of the sample among all of it."""
        picked = np.arange(0, len(sample), max(1, len(sample) // TRIALS))[:TRIALS]
        if len(sample) <= nearest + 1:
            return REACHES[-1]
        s = sample[picked] @ sample.T
        s[np.arange(len(picked)), picked] = -np.inf
        best = np.argpartition(-s, nearest, axis=1)[:, :nearest]
        asked = self.codes(sample[picked], True)
        for reach in REACHES:
            self.enough = min(1.0 * len(sample) * self.trees, reach * len(sample))
            low, high = self.ranges(asked)
            found = np.zeros(best.shape, dtype=bool)
            for t in range(self.trees):
                c = codes[:, t][best]
                found |= (c >= low[:, t, None]) & (c <= high[:, t, None])
            if found.mean() >= RECALL:
                return reach
        return REACHES[-1]

    def codes(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """The hash strings of rows as integers, first bit highest; one column a tree."""
        last = np.zeros((len(x), 1))
        if not queries:
            # One more coordinate makes all lengths equal: the largest inner product is then the smallest angle.
            x = x - self.mean
            last = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1, keepdims=True), 0))
        bits = (np.hstack([x, last]) @ self.planes > 0).reshape(len(x), self.trees, BITS)
        return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last code of each query's range in each tree, at the level where its ascent ends."""
        level = np.full(len(codes), -1)
        for bits in range(BITS, -1, -1):
            shift = BITS - bits
            held = np.zeros(len(codes))
            for t in range(self.trees):
                low = (codes[:, t] >> shift) << shift
                held += np.searchsorted(self.sorted[t], low + (1 << shift), side="left") - np.searchsorted(self.sorted[t], low, side="left")
            level[(level < 0) & ((held >= self.enough) | (bits == 0))] = shift
        low = (codes >> level[:, None]) << level[:, None]
        return low, low + (np.int64(1) << level[:, None]) - 1


def _vectors(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 0))


def _placed(rows: DataFrame, forest, queries: bool) -> DataFrame:
    """A row for each tree and block: the block's number, codes (first and last), id and vector bytes.

    Where very many rows share a block, or very many queries meet it, it is dealt out in parts by id, and every part of
    its rows meets every part of its queries in a task of its own.
    """

    def work(batches):
        import pyarrow as pa

        f = forest  # travels with the function, a few MB at most
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch.column("v"))
            ids = batch.column("vec_id").to_numpy()
            codes = f.codes(x, queries)
            low, high = f.ranges(codes) if queries else (codes, codes)
            raw = np.array([r.tobytes() for r in x.astype("<f8" if f.wide else "<f4")], dtype=object)
            out: list[list] = [[] for _ in range(6)]
            for t in range(f.trees):
                a, b = np.searchsorted(f.bounds[t], low[:, t], side="right"), np.searchsorted(f.bounds[t], high[:, t], side="right")
                n = b - a + 1
                who = np.repeat(np.arange(len(ids)), n)
                block = np.repeat(a, n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                own, other = (f.asked[t], f.parts[t]) if queries else (f.parts[t], f.asked[t])
                m = other[block]
                who, block = np.repeat(who, m), np.repeat(block, m)
                part, all_ = mix64(ids[who].astype(np.uint64)) % own[block].astype(np.uint64), np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m)
                cell = part.astype(np.int64) * other[block] + all_ if queries else all_ * own[block] + part.astype(np.int64)
                for col, v in zip(out, (np.full(len(who), t), block << 32 | cell, low[who, t], high[who, t], ids[who], raw[who]), strict=True):
                    col.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            for i in range(f.trees):
                yield pa.RecordBatch.from_arrays([pa.array(c[i], k) for c, k in zip(out, kinds, strict=True)], names=["tree", "block", "low", "high", "id", "raw"])

    return rows.mapInArrow(work, "tree int, block long, low long, high long, id long, raw binary")


def neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, trees: int = TREES, reach: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its nearest other rows of vectors that were found.

    Both tables have vec_id and embedding. Without a reach the one is taken that a sample asks for. Nearness is the inner product in double precision of the vectors as they
    are; ties go to the smaller vec_id. A query is never its own neighbour. Vectors that are null, zero, or hold null
    or non-finite components take no part, nor do those of another length than most; rows of a null vec_id neither.
    Of rows with the very same vector, only the smallest nearest + 1 ids can be among a query's nearest, and only they
    enter the trees, so that a vector shared by a third of all rows costs no more than another. Repeated vec_ids with
    equal vectors count as one. Empty tables give an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "forest")
    wide = dict(vectors.dtypes)["embedding"] != "array<float>"
    kind = "array<double>" if wide else "array<float>"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast(kind)
        fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda c: c != 0))

    sized = usable(vectors)
    lengths = sized.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], empty)
    d = lengths["d"]
    same = W.partitionBy("v").orderBy("vec_id")
    rows = sized.filter(F.size("v") == d).distinct().withColumn("k", F.row_number().over(same)).filter(F.col("k") <= nearest + 1).drop("k")
    rows = scratch.keep(rows)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample = _vectors(picked.column("v").combine_chunks())
    mean = sample.mean(axis=0)
    # Over all rows, so that every batch of them is hashed alike.
    apart = F.zip_with("v", F.lit(mean.tolist()), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    whole = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate(apart, F.lit(0.0), lambda a, c: a + c))).alias("norm")).first()
    asking = scratch.keep(usable(queries).filter(F.size("v") == d).distinct())
    forest = Forest(sample, mean, whole["norm"], whole["n"], asking.count(), trees, reach, nearest)
    forest.wide = wide
    index, asked = _placed(rows, forest, False), _placed(asking, forest, True)
    kind_ = np.dtype("<f8" if wide else "<f4")

    def search(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        left = left.sort_values(["low", "id"], kind="stable")
        codes, ids = left["low"].to_numpy(), left["id"].to_numpy()
        x = np.frombuffer(b"".join(left["raw"]), dtype=kind_).reshape(len(left), d).astype(np.float64)
        q = np.frombuffer(b"".join(right["raw"]), dtype=kind_).reshape(len(right), d).astype(np.float64)
        names = right["id"].to_numpy()
        slack = 4 * d * np.finfo(np.float64).eps * np.sqrt((x**2).sum(axis=1).max())
        first = np.searchsorted(codes, right["low"].to_numpy(), side="left")
        last = np.searchsorted(codes, right["high"].to_numpy(), side="right")
        got: list[tuple] = []
        # Queries with the same range are scored together, in pieces whose scores take a bounded space.
        order = np.lexsort((last, first))
        cut = np.flatnonzero(np.diff(first[order]) | np.diff(last[order])) + 1
        for some in np.split(order, cut):
            a, b = first[some[0]], last[some[0]]
            if b <= a:
                continue
            for piece in np.array_split(some, -(-(len(some) * (b - a)) // 4_000_000)):
                s = q[piece] @ x[a:b].T
                s[ids[None, a:b] == names[piece][:, None]] = -np.inf
                k = min(nearest + 8, b - a)
                # All rows that tie at the bound, less what rounding may differ by, are ranked exactly before the cut.
                bound = np.partition(s, b - a - k, axis=1)[:, b - a - k] - slack * np.sqrt((q[piece] ** 2).sum(axis=1))
                for i, own, least in zip(piece.tolist(), s, bound, strict=True):
                    row = np.flatnonzero(own >= least)
                    row = row[ids[a + row] != names[i]]
                    exact = (x[a + row] * q[i]).sum(axis=1)
                    top = np.lexsort((ids[a + row], -exact))[:k]
                    got.append((np.full(len(top), names[i]), ids[a + row[top]], exact[top]))
        cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    found = index.groupBy("tree", "block").cogroup(asked.groupBy("tree", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found for every embedding whose vec_id is divisible by 20."""
    rows = read(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.filter(F.col("vec_id") % EVERY == 0))
