"""Exact dedup by distributed MSD radix partitioning: no digest decides equality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Bitmap, Scratch, either, read, tune

#: White space that does not count: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
#: Bytes in the first radix digit; each later round reads GROWTH times as many bytes.
FIRST, GROWTH = 16, 8


def radix_groups(docs: DataFrame, rows: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept and norm_sha256 for every row of docs; with rows also ``row``, its columns.

    Rows are equal when their texts are identical after white space is deleted. The first digit is the byte length with
    the first bytes; every round splits the groups that are left by their next bytes, and groups of one row or at
    their end leave. Within a group the row with the most code points stays, then the smallest doc_id (null last); of
    rows that share that too, exactly one. The digest is a column of the result only, it never decides.

    The first round moves only lengths and first bytes; the texts of rows that are still in a group are read again
    for the rounds after it. Null texts count as empty, and empty texts are equal to each other. An empty table gives
    an empty result; other columns are carried along untouched, whatever their names.
    """
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(either(docs, "text", "string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scan = docs.select(row, either(docs, "doc_id", "long").alias("id"), F.length(text).alias("cp"), _bytes(text).alias("whole"))
    scan = scan.select("*", F.octet_length("whole").alias("n"), F.substring("whole", 1, FIRST).alias("digit"))
    # The length joins the first digit, so that all rows of a group end in the same round.
    slim = scratch.keep(scan.select("id", "cp", "n", "digit", F.sha2("whole", 256).alias("sha"), F.monotonically_increasing_id().alias("uid")))
    groups = slim.groupBy("n", "digit").agg(F.count("*").alias("size"), F.min("uid").alias("gid")).filter("size > 1").drop("size")
    grouped = scratch.keep(slim.select("id", "n", "digit", "uid").join(groups, ["n", "digit"]))
    seen = Bitmap(grouped, "id")
    again = scan.filter(seen.maybe("id"))
    entry = grouped.select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("digit").alias("digit2"), "gid").distinct()
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("n") == F.col("n2")) & (F.col("digit") == F.col("digit2"))
    fields = ["row", "id", "cp", "n", "gid", "uid", "rest"]
    fetched = again.join(entry, same, "left" if rows else "inner").select(
        "row", "id", "cp", "n", "gid", F.monotonically_increasing_id().alias("uid"), F.expr(f"if(gid is null, null, substring(whole, {FIRST + 1}))").alias("rest"), F.sha2("whole", 256).alias("sha")
    )
    if not rows:
        fetched = fetched.withColumn("row", F.lit(None).cast("string"))
    fields.append("sha")
    state = scratch.keep(fetched)
    if rows:
        quiet = scan.filter(~seen.maybe("id")).select("row", "id", F.sha2("whole", 256).alias("sha"))
        done = [quiet, state.filter("gid is null").select("row", "id", "sha")]
    else:
        alone = slim.join(groups, ["n", "digit"], "left_anti")
        done = [alone.select(F.lit(None).cast("string").alias("row"), "id", "sha")]
    left, at, width = state.filter("gid is not null"), FIRST, FIRST * GROWTH
    ended = []
    while (longest := left.agg(F.max("n")).first()[0]) is not None and longest > at:
        ended.append(left.filter(F.col("n") <= at))
        going = left.filter(F.col("n") > at).withColumn("digit", F.substring("rest", 1, width))
        split = going.groupBy("gid", "digit").agg(F.count("*").alias("size"), F.min("uid").alias("next")).filter("size > 1").drop("size")
        marked = going.join(split, ["gid", "digit"], "left").withColumn("rest", F.expr(f"if(next is null, null, substring(rest, {width + 1}))"))
        state = scratch.keep(marked.withColumn("gid", F.col("next")).select(*fields))
        done.append(state.filter("gid is null").select("row", "id", "sha"))
        left, at, width = state.filter("gid is not null"), at + width, width * GROWTH
    ended.append(left)
    copies = reduce(DataFrame.unionByName, [e.drop("rest", "n") for e in ended])
    rank = F.struct((-F.col("cp")).alias("cp"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    keepers = copies.groupBy("gid").agg(F.min(rank).alias("best"), F.count("*").alias("group_size"))
    copied = copies.join(keepers, "gid").select("row", F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("norm_sha256"))
    single = reduce(DataFrame.unionByName, done).select("row", F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("norm_sha256"))
    out = single.unionByName(copied)
    return out if rows else out.drop("row")


def _bytes(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text.cast("binary")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of documents."""
    rows = radix_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumnRenamed("norm_sha256", "text_sha256")


ORACLE_OP10 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
       sha256(norm) AS text_sha256
FROM k
"""
