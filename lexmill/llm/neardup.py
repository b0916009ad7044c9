"""MinHash near-dedup by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm.common import Bitmap, Scratch, components, either, mix64, read, tune

#: Words of a shingle in the contract of op6; the operator's own default is five.
CONTRACT_WORDS, WORDS = 4, 5
#: Links have PERCENT[0] * shared >= PERCENT[1] * all shingles of two documents.
PERCENT = (100, 80)
#: Bands and coordinates of each: a pair at similarity 0.8 is missed with probability (1 - 0.8**6)**64 < 4e-9.
BANDS, ROWS = 64, 6
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text, A-Z in lower case.

    Words are runs of anything but U+0020 and U+0009 to U+000D; a text of fewer words is one shingle, one of none has
    none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    size = min(k, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, np.uint64(size))
        for i in range(size):
            out = mix64(out * _ODD[0] + h[i : len(h) - size + 1 + i] * _ODD[1 + i % 7])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A t-coordinate fast similarity sketch of each set (none empty).

    In round i < t every element draws a bin and a value and each bin keeps its least (round, value); in round t + j
    every element falls into bin j, so that every coordinate is filled after 2t rounds at the latest, and most sets
    are done after t log(t) / size of them. Two sets agree in a coordinate with the probability of their similarity,
    and the number of agreements concentrates as for independent hashes.
    """
    n = len(sets)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full((n, t), full, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    for i in range(2 * t):
        if not len(flat):
            break
        with np.errstate(over="ignore"):
            h = mix64(flat ^ (np.uint64(i + 1) * _ODD[0]))
        value = (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16))
        if i < t:
            slot = ((h & np.uint64(0xFFFF)) * np.uint64(t)) >> np.uint64(16)
            np.minimum.at(best.reshape(-1), owner * t + slot.astype(np.int64), value)
        else:
            np.minimum.at(best.reshape(-1), owner * t + (i - t), value)
        open_ = (best == full).any(axis=1)
        going = open_[owner]
        if not going.all():
            flat, owner = flat[going], owner[going]
    return best


def bands(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch; the band's number is part of it."""
    grouped = sketch.reshape(len(sketch), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _ODD[2] * np.ones((len(sketch), 1), dtype=np.uint64)
        for r in range(ROWS):
            key = mix64(key * _ODD[0] + grouped[:, :, r])
    return key


def _lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def fingerprints(rows: DataFrame, k: int) -> DataFrame:
    """(doc, twin, n, h1, h2, bands): set size, a 128-bit digest of the set and its band keys (null for the empty set)."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingles(t, k) for t in batch.column("text").to_pylist()]
            digest = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = iter(bands(sketches([sets[i] for i in full], BANDS * ROWS)))
            none = np.zeros(0, dtype=np.uint64)
            own = [next(keys) if len(s) else none for s in sets]
            low = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digest], dtype=np.uint64).view(np.int64)
            high = np.array([d >> 64 for d in digest], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("twin"), pa.array([len(s) for s in sets], pa.int64()), pa.array(low), pa.array(high), _lists(own)], names=["doc", "twin", "n", "h1", "h2", "bands"])

    return rows.mapInArrow(work, "doc long, twin long, n long, h1 long, h2 long, bands array<long>")


def shingle_sets(rows: DataFrame, k: int) -> DataFrame:
    """(id, s): the whole shingle set of each row."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists([shingles(t, k) for t in batch.column("text").to_pylist()])], names=["id", "s"])

    return rows.mapInArrow(work, "id long, s array<long>")


class _Verifier:
    """Exact similarity of candidate pairs of nodes; a text is read for the pairs it is in, and no more."""

    def __init__(self, scratch: Scratch, rows: DataFrame, nodes: DataFrame, k: int):
        self.scratch, self.rows, self.nodes, self.k = scratch, rows, nodes.select("id", "doc", "twin"), k

    def sets(self, ids: DataFrame) -> DataFrame:
        """The shingle sets of those nodes, from the text of the row that stands for each."""
        wanted = self.scratch.keep(self.nodes.join(ids, "id", "left_semi"))
        thin = self.rows.filter(Bitmap(wanted, "doc").maybe("doc"))
        return self.scratch.keep(shingle_sets(thin.join(wanted, ["doc", "twin"]).select("id", "text"), self.k).dropDuplicates(["id"]))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links. Either side may be hot; the joins are left to split it."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        sets = self.sets(ids)
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb")).cast("long")
        total = F.size("sa") + F.size("sb") - F.col("shared")
        found = both.select("a", "b", "sa", "sb", shared.alias("shared")).filter(PERCENT[0] * F.col("shared") >= PERCENT[1] * total)
        out = self.scratch.keep(found.select("a", "b"))
        self.scratch.drop(sets)
        return out


def near_duplicates(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    A node of the graph is a distinct shingle set, so that large groups of copies cost one row; the row of the smallest
    doc_id stands for it. In every bucket of a band all members are compared with its smallest node; buckets that the
    links found leave in more than one component are compared with their largest node too. Members of buckets that are
    still apart are joined on their rarest shingles, which misses no link, so that no bucket ever spends the square of
    its size. Sets are compared whole, as 64-bit hashes of their shingles: that two different shingles of a pair with n
    of them meet in one hash, and so could move its similarity at all, has a chance of n**2 / 2**65.

    Null and empty texts have no shingles and are linked with nothing. Repeated doc_ids, with equal or different texts,
    tie the sets of all their rows together: the component of a doc_id is that of any of its rows, and each row is
    returned. A null doc_id stays alone with a null component and is kept. An empty table gives an empty result; a text
    of any length is read as a whole; other columns are not read, whatever their names.
    """
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "neardup")
    text = either(docs, "text", "string")
    rows = docs.select(either(docs, "doc_id", "long").alias("doc"), F.xxhash64(text).alias("twin"), text.alias("text"))
    prints = scratch.keep(fingerprints(rows, k))
    named, whole = prints.filter("n > 0 and doc is not null"), ["n", "h1", "h2"]
    # By doc_id, so that the smallest node of a component has its smallest doc_id.
    by_set = named.groupBy(*whole).agg(F.min(F.struct("doc", "twin")).alias("one"), F.first("bands").alias("bands")).select(*whole, "one.*", "bands")
    nodes = scratch.keep(by_set.select(F.monotonically_increasing_id().alias("id"), *whole, "doc", "twin", "bands"))
    placed = scratch.keep(prints.drop("bands", "twin").join(nodes.select("id", *whole, F.col("doc").alias("low")), whole, "left").withColumn("id", F.expr("if(doc is null, null, id)")))
    # Rows of one doc_id that are not of one node.
    least, empty = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "low"))).alias("a"), F.count_if(F.col("id").isNull()).alias("e")
    spread = scratch.keep(placed.filter("doc is not null").groupBy("doc").agg(least, F.max("id").alias("z"), empty).filter("a.id <> z or a is not null and e > 0").select("doc", "a"))
    tied = None
    if not spread.isEmpty():
        tied = scratch.keep(placed.join(spread, "doc").filter("id <> a.id").select(F.col("a.id").alias("a"), F.col("id").alias("b")).distinct())
        placed = scratch.keep(placed.join(spread, "doc", "left").select("doc", "n", F.coalesce("id", "a.id").alias("id"), F.coalesce("low", "a.low").alias("low")))
    keyed = scratch.keep(nodes.select("id", "n", F.explode("bands").alias("key")))
    buckets = scratch.keep(keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("m")).filter("m > 1"))
    members = scratch.keep(keyed.join(buckets.select("key", "low", "high"), "key"))
    scratch.drop(keyed, buckets)
    check = _Verifier(scratch, rows, nodes, k)
    # Sizes alone rule a pair out if the smaller set is under 80 % of the larger.
    first = members.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    first = scratch.keep(first)
    links = check.links(first)
    links = links.union(tied) if tied else links
    parts = components(scratch, links)
    open_ = _open(scratch, members, parts)
    top = open_.filter("id = high").select("key", F.col("part").alias("other"), F.col("n").alias("n2"))
    second = open_.join(top, "key").filter("part <> other").filter(_sizes("n", "n2")).select(F.least("id", "high").alias("a"), F.greatest("id", "high").alias("b")).distinct()
    second = scratch.keep(second.join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        links = links.union(check.links(second))
        parts = components(scratch, links)
        scratch.drop(open_)
        open_ = _open(scratch, members, parts)
    last = scratch.keep(_prefix_pairs(scratch, check, open_.select("id", "n", "part").distinct()).join(first.union(second), ["a", "b"], "left_anti"))
    if not last.isEmpty():
        links = links.union(check.links(last))
        parts = components(scratch, links)
    least = nodes.select("id", "doc").join(parts, "id").groupBy("component").agg(F.min("doc").alias("first"))
    linked = scratch.keep(parts.join(least, "component").select("id", "first"))
    out = placed.join(linked, "id", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("first", "low", "doc").alias("component_id"))
    out = out.withColumn("component_id", F.expr("if(doc_id is null, null, component_id)"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _open(scratch: Scratch, members: DataFrame, parts: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    placed = members.join(parts, "id", "left").select("key", "id", "n", "low", "high", F.coalesce("component", "id").alias("part"))
    split = placed.groupBy("key").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).filter("p1 <> p2").select("key")
    return scratch.keep(placed.join(split, "key"))


def _prefix_pairs(scratch: Scratch, check: _Verifier, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of docs (id, n, part) in different components that may be links; no link is left out.

    A link shares 80 % of either set, so it shares one of the first n - ceil(0.8 n) + 1 shingles of both in any common
    order. In the order of rarity a document that differs from all others in a fifth of its shingles has only shingles
    of its own there and meets nothing, however many documents share the rest of it.
    """
    sets = check.sets(docs.select("id"))
    words = sets.select("id", F.explode("s").alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("df")).filter("df > 1")
    shared = words.join(often, "w").join(docs, "id")
    mine = W.partitionBy("id")
    own = shared.withColumn("k", F.row_number().over(mine.orderBy("df", "w"))).withColumn("m", F.count("*").over(mine))
    # Places in the order of rarity; a document's own shingles come before all shared ones.
    own = own.withColumn("at", F.col("n") - F.col("m") + F.col("k"))
    first = F.col("n") - F.ceil(F.col("n") * PERCENT[1] / PERCENT[0]) + 1
    short = scratch.keep(own.filter(F.col("at") <= first).select("w", "id", "n", "part", "at"))
    split = short.groupBy("w").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).filter("p1 <> p2").select("w")
    some = scratch.keep(short.join(split, "w"))
    x, y = some.select("w", F.col("id").alias("a"), "n", "part", "at"), some.select("w", F.col("id").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("n", "part", "at")])
    # The first shingle that a link shares has enough places behind it on both sides for all that it must share.
    behind = 1 + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    reach = (PERCENT[0] + PERCENT[1]) * behind >= PERCENT[1] * (F.col("n") + F.col("n2"))
    pairs = x.join(y, (x["w"] == y["w"]) & (F.col("part") < F.col("part2")) & _sizes("n", "n2") & reach)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sizes(a: str, b: str):
    return PERCENT[0] * F.least(a, b) >= PERCENT[1] * F.greatest(a, b)


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document, at four-word shingles and similarity 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents"), CONTRACT_WORDS)


ORACLE_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s
  FROM w
), k AS (  -- equal sets go by their smallest id
  SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS rep FROM s
), x AS (
  SELECT k.rep, k.n, unnest(s.s) AS g FROM k JOIN s ON s.doc_id = k.doc_id WHERE k.rep = k.doc_id
), l AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r(a, b) AS (
  SELECT DISTINCT rep, rep FROM k UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (
  SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM k JOIN c USING (rep)
"""
