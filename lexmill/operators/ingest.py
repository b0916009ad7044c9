"""Ingest of uploads, retries and the start of analyses: each step is a relation of rows to append, none rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Seconds before a job runs again: when the worker's evaluators differ from those it was made for, and after an error.
SKEW_DELAY, ERROR_DELAY = 60, 10
#: A review in one of these is past analysis.
CLOSED_TO_ANALYSIS = ("RESOLVED", "CLOSED", "CANCELLED")


def new_versions(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """uploads (contract_id, upload_id, file_hash, ...) as versions of their contracts, numbered on from the stored ones
    in order of upload_id, with duplicate_of, the first version of the same contract that has the same bytes.

    stored: contract_id, version_number, file_hash, version_id. A duplicate is noted and not held back. The same bytes
    in another contract are none.

    All of it is worked out where the versions of a contract lie, so that uploads and stored versions move once. Uploads
    of no contract, or without a hash, are versions like any other: nulls are one contract, and one hash.
    """
    old = stored.select("contract_id", "file_hash", F.col("version_number").cast("long").alias("number"), F.col("version_id").alias("id"), F.lit(None).cast(uploads.schema).alias("row"))
    new = uploads.select("contract_id", "file_hash", F.lit(None).cast("long").alias("number"), F.col("upload_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in uploads.columns]).alias("row"))
    contract = W.partitionBy("contract_id")
    place = F.row_number().over(contract.orderBy(F.col("row").isNull(), "row.upload_id"))
    numbered = old.unionByName(new).withColumn("top", F.coalesce(F.max("number").over(contract), F.lit(0))).withColumn("number", F.coalesce("number", (F.col("top") + place).cast("long")))
    rows = numbered.withColumn("first", F.min(F.struct("number", "id")).over(W.partitionBy("contract_id", "file_hash"))).filter("row is not null")
    return rows.select("row.*", F.col("number").alias("version_number"), F.when(F.col("first.number") < F.col("number"), F.col("first.id")).alias("duplicate_of"))


def evidence_rows(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """Evidence of the runs that read something: each segment under its run, with its place in reading order.

    Order is by page and offset; segments without a page come last.
    """
    rows = segments.join(runs.filter(F.col("status") == "COMPLETED").select("run_id", "version_id"), "version_id")
    order = W.partitionBy("run_id").orderBy(F.col("page_number").asc_nulls_last(), "start_offset", "evidence_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def processing_runs(versions: DataFrame, parsed: DataFrame, attempts: DataFrame | None = None, kind: str = "PARSE") -> DataFrame:
    """A run for each version: its number, status, error code and how many pieces of evidence it left.

    parsed: version_id, extraction_status (FAILED where nothing could be read), segments. attempts, the runs so far
    (version_id, attempt), are kept: a new run goes behind them.
    """
    rows = versions.select("version_id").join(parsed, "version_id", "left")
    if attempts is None:
        rows = rows.withColumn("last", F.lit(0))
    else:
        rows = rows.join(attempts.groupBy("version_id").agg(F.max("attempt").alias("last")), "version_id", "left")
    failed = F.coalesce(F.col("extraction_status") == "FAILED", F.lit(True))
    attempt = (F.coalesce("last", F.lit(0)) + 1).cast("long")
    return rows.select(
        "version_id", attempt.alias("attempt"), F.concat_ws(":", "version_id", attempt.cast("string")).alias("run_id"), F.lit(kind).alias("run_type"),
        F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"), F.when(failed, "EXTRACTION_FAILED").alias("error_code"),
        F.when(failed, 0).otherwise(F.coalesce("segments", F.lit(0))).cast("long").alias("evidence_count"),
    )


def to_retry(runs: DataFrame) -> DataFrame:
    """(version_id) of the versions whose last attempt failed."""
    return runs.groupBy("version_id").agg(F.max_by("status", "attempt").alias("status")).filter("status = 'FAILED'").select("version_id")


def may_analyse(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """reviews with findings (their number) and refusal: a review is analysed once, and never after it was closed."""
    n = findings.groupBy("review_id").agg(F.count("*").alias("findings"))
    rows = reviews.join(n, "review_id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)).cast("long"))
    return rows.withColumn("refusal", F.when(F.col("findings") > 0, "already analysed").when(F.col("status").isin(*CLOSED_TO_ANALYSIS), "closed to analysis"))


def queue_jobs(reviews: DataFrame, fingerprint: Column) -> DataFrame:
    """Jobs of the reviews that may_analyse() lets pass: identifiers and the evaluators' fingerprint, nothing else."""
    return reviews.filter(F.col("refusal").isNull()).select("review_id", F.col("created_by").alias("actor_id"), fingerprint.alias("fingerprint"))


def retry_delay(outcome: Column) -> Column:
    """Seconds until a job is tried again; null where it is not: done, or refused, which no retry would change."""
    return F.when(outcome == "SKEW", SKEW_DELAY).when(outcome == "ERROR", ERROR_DELAY)


def open_reviews(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests with the review they lead to: the first stored one (by creation, then id) of the same version, snapshot
    and creator, else the first request of them; created tells which ones are new."""
    key = ["version_id", "snapshot_id", "created_by"]
    had = stored.groupBy(*key).agg(F.min(F.struct("created_at", "review_id")).alias("old"))
    asked = requests.groupBy(*key).agg(F.min("request_id").alias("first"))
    rows = requests.join(asked, key).join(had, key, "left")
    new = F.col("old").isNull()
    return rows.select("request_id", *key, F.coalesce(F.col("old.review_id"), F.col("first")).alias("review_id"), (new & (F.col("request_id") == F.col("first"))).alias("created"))
