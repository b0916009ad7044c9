"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Scratch, either, numbered, read, tune, whole_row

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: The mix holds SHARE[0] / SHARE[1] of all words, and no source more than CAP times its own.
SHARE, CAP = (3, 2), 2
SEED = "lexmill-mix-2"
#: So many offsets are drawn for a source; the one that brings its words nearest to its target counts.
DRAWS = 64


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted parts of share times all sizes, stopped at
    cap times the size.

    What a stopped source leaves goes to the others by weight, again and again until none is above its stop. Every
    open source gets the same number of words for one unit of weight; it is a fraction that only rises from round to
    round, so a round is one sum over the sources, and its numbers are all that reaches the driver. They are whole
    numbers throughout, so no rounding decides who is stopped.
    """
    whole = lambda x: F.lit(x).cast("decimal(38,0)") if isinstance(x, int) else x.cast("decimal(38,0)")
    order = F.col("source").asc_nulls_last()
    at = numbered(scratch, sizes, order)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    rows = scratch.keep(at.select("source", "source_size", weight.cast("long").alias("w")))
    stopped, rate, before = F.lit(False), (0, 1), -1
    while True:
        open_weight = F.sum(F.when(stopped, F.lit(0)).otherwise(F.col("w")))
        held = F.sum(F.when(stopped, F.col("source_size")).otherwise(F.lit(0)))
        r = rows.agg(F.sum("source_size").alias("all"), open_weight.alias("open"), held.alias("held"), F.count_if(stopped).alias("n")).first()
        if not r["open"] or r["n"] == before:
            break
        before, rate = r["n"], (share[0] * r["all"] - share[1] * cap * r["held"], share[1] * r["open"])
        stopped = whole(F.col("w")) * whole(rate[0]) > whole(F.col("source_size")) * whole(cap * rate[1])
    part = (F.col("w") * F.lit(rate[0])).cast("double") / F.lit(float(rate[1]))
    return rows.select("source", "source_size", F.when(stopped, (F.col("source_size") * cap).cast("double")).otherwise(part).alias("target"))


def word_count(text):
    """Runs of anything but U+0020 and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long"), F.lit(0).cast("long"))


def _offsets(source):
    """DRAWS numbers from 0 up to 1 for a source."""
    digest = lambda i: F.md5(F.concat(F.lit(f"{SEED}|{i}|"), F.coalesce(source, F.lit(""))))
    return F.array(*[F.conv(F.substring(digest(i), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) for i in range(DRAWS)])


def mix(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often each document enters the mix.

    Within a source every document expects target / source_size copies. Documents are ordered by (size, doc_id), so
    that the draw is spread evenly over small and large ones; one offset per source, drawn from SEED, is added to the
    running sum of expected copies, and a document is emitted once for each integer its interval crosses. Where a source
    holds few documents or some very long ones, the offset alone decides over many words, so it is drawn DRAWS times and
    the draw whose words come nearest to the target counts, the first of equals. The sum is
    the place in the source times the expectation, and places come from one order of all documents by source, size and
    id, dealt out in ranges, so that neither a large source nor a common size is one task's. No document appears more
    often than the ceiling of that expectation, CAP times at most, and reruns agree.

    Null texts have size 0. Rows of one doc_id, source and size count as one in the order and each get its copies. A
    null source is a source of its own, null ids come first in their size. A text of any length is counted as a whole.
    An empty table gives an empty result; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = scratch or Scratch(spark, "mix")
    rows = docs.select(either(docs, "doc_id", "long").alias("doc_id"), either(docs, "source", "string").alias("source"), word_count(either(docs, "text", "string")).alias("size"))
    slim = scratch.keep(rows)
    sizes = scratch.keep(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    distinct = slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    at = scratch.keep(numbered(scratch, distinct, F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_first()))
    first = at.groupBy("source").agg(F.min("place").alias("first"))
    t, f = targets(scratch, sizes).alias("t"), first.alias("f")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = scratch.keep(t.join(f, F.col("t.source").eqNullSafe(F.col("f.source"))).select("t.*", "f.first", rate.alias("rate"), _offsets(F.col("t.source")).alias("offsets")))
    a, g = at.alias("a"), goals.alias("g")
    joined = a.join(g, F.col("a.source").eqNullSafe(F.col("g.source")))
    k = (F.col("place") - F.col("first") + 1).cast("double")
    crossed = lambda u: (F.floor(u + k * F.col("rate")) - F.floor(u + (k - 1) * F.col("rate"))).cast("long")
    words = [F.sum(F.col("size") * F.col("rows") * crossed(F.get("offsets", F.lit(i)))).alias(f"w{i}") for i in range(DRAWS)]
    drawn = joined.groupBy("g.source", "target", "offsets").agg(*words)
    misses = F.array(*[F.struct(F.abs(F.col(f"w{i}") - F.col("target")), F.lit(i), F.get("offsets", F.lit(i)).alias("offset")) for i in range(DRAWS)])
    c = scratch.keep(drawn.select("source", F.array_min(misses)["offset"].alias("offset"))).alias("c")
    chosen = g.join(c, F.col("g.source").eqNullSafe(F.col("c.source"))).select("g.*", "c.offset").alias("g")
    out = a.join(chosen, F.col("a.source").eqNullSafe(F.col("g.source")))
    copies = crossed(F.col("offset"))
    per_key = out.select("a.doc_id", "a.source", "a.size", "source_size", "target", copies.alias("copies"))
    if slim.count() == at.count():
        return per_key
    p, s = per_key.alias("p"), slim.alias("s")
    same = F.col("p.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.size") == F.col("s.size"))
    return s.join(p, same).select("p.*")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix themselves, each as often as it was drawn, with the columns of docs and no others,
    whatever their names; nulls, repeated rows and empty tables as in mix()."""
    plan = mix(docs).filter("copies > 0").select("doc_id", "source", "size", "copies").distinct()
    d = docs.select(whole_row(docs).alias("row"), either(docs, "doc_id", "long").alias("doc_id"), either(docs, "source", "string").alias("source"), word_count(either(docs, "text", "string")).alias("size")).alias("d")
    p = plan.alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))
    drawn = d.join(p, same).select("d.row", F.explode(F.sequence(F.lit(1), F.col("p.copies").cast("int"))).alias("copy"))
    return drawn.select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document; copies is added."""
    rows = mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE_OP5 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), o AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         sum(source_size) OVER () AS total
  FROM s
), f AS (  -- in the order in which sources reach their stop
  SELECT *, sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
         3 * total - coalesce(sum(4 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS twice_left
  FROM o
), g AS (
  SELECT *, w * twice_left > 4 * source_size * w_left AS stopped FROM f
), h AS (
  SELECT *, min(CASE WHEN NOT stopped THEN source_size / w END) OVER () AS first_open FROM g
), l AS (
  SELECT DISTINCT twice_left AS num, w_left AS den FROM h WHERE NOT stopped AND source_size / w = first_open
), t AS (
  SELECT source, source_size,
         CASE WHEN stopped THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(w * (SELECT max(num) FROM l WHERE den = (SELECT max(den) FROM l)) AS DOUBLE) / CAST(2 * (SELECT max(den) FROM l) AS DOUBLE) END AS target
  FROM h
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS DOUBLE) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT source, i, CAST(CAST('0x' || substr(md5('{SEED}|' || i || '|' || coalesce(source, '')), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM t, range({DRAWS}) AS draws(i)
), w AS (
  SELECT u.source, i, u, abs(sum(size * (floor(u + k * rate) - floor(u + (k - 1) * rate))) - any_value(target)) AS miss
  FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source GROUP BY u.source, i, u
), c AS (
  SELECT source, u FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss, i) AS place FROM w) WHERE place = 1
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(u + k * rate) - floor(u + (k - 1) * rate)) AS BIGINT) AS taken,
       CAST(floor(u + k * rate) - floor(u + (k - 1) * rate) AS BIGINT) AS copies
FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source
"""
