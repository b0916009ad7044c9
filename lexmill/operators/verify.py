"""Self-checks: terminology against its source, reproducible records, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def terminology(standards: DataFrame, states: DataFrame, caps: DataFrame) -> DataFrame:
    """(code, verdict, reason) for each standard: whether its own source gives back the position that was ratified.

    standards: code, evaluator_type, has_rules, source, source_present, scope_key, preferred, unit, basis; states: code,
    state of the mapping on that source; caps: code, scope, status, value, unit, basis of what was read from it.
    Without rules or a named source it fails, without the source at hand it is skipped, without a confirmed mapping it
    fails; a presence passes then, a number only if its scope states the ratified position and no other.
    """
    position = F.struct("status", "value", "unit", "basis")
    read = caps.join(standards.select("code", F.col("scope_key").alias("scope")), ["code", "scope"]).groupBy("code").agg(F.collect_set(position).alias("positions"))
    rows = standards.join(states.select("code", "state"), "code", "left").join(read, "code", "left")
    want = F.struct(F.lit("FINITE").alias("status"), F.col("preferred").cast("double").alias("value"), "unit", "basis")
    n = F.coalesce(F.size("positions"), F.lit(0))
    reason = (
        F.when(~F.col("has_rules") | F.col("source").isNull(), "no rules or source")
        .when(~F.col("source_present"), "source not present")
        .when(~F.coalesce(F.col("state") == "CONFIRMED", F.lit(False)), "mapping not confirmed")
        .when(F.col("evaluator_type") == "PRESENCE", None)
        .when(n == 0, "no position")
        .when((n > 1) | (F.get("positions", F.lit(0)) != want), "another position")
    )
    rows = rows.withColumn("reason", reason)
    verdict = F.when(F.col("reason").isNull(), "PASS").when(F.col("reason") == "source not present", "SKIP").otherwise("FAIL")
    return rows.select("code", verdict.alias("verdict"), "reason")


def tally(verdicts: DataFrame, column: str = "verdict") -> DataFrame:
    """How many passed, failed and were skipped."""
    n = lambda v: F.count_if(F.col(column) == v).cast("long").alias(v.lower())
    return verdicts.agg(n("PASS"), n("FAIL"), n("SKIP"))


def record_digest(findings: DataFrame, evaluations: DataFrame, review: str = "review_id") -> DataFrame:
    """(review, findings, digest) of what a repeated analysis has to give again: ids and times are not part of it.

    findings: review, code, classification, status; evaluations: review, code, scope_key, evaluation_kind, scope_label,
    classification, rule_outcome, evidence_count. Each finding's part is digested where its evaluations are, so that a
    review's record is a list of digests and not of rows.
    """
    item = F.struct("scope_key", "evaluation_kind", F.coalesce("scope_label", F.lit("")).alias("scope_label"), "classification", "rule_outcome", "evidence_count")
    per = evaluations.groupBy(review, "code").agg(F.sort_array(F.collect_list(item)).alias("e"))
    line = F.transform("e", lambda e: F.concat_ws("|", e["scope_key"], e["evaluation_kind"], e["scope_label"], e["classification"], e["rule_outcome"], e["evidence_count"].cast("string")))
    own = F.sha2(F.concat_ws("\n", F.concat_ws("|", "code", "classification", "status"), F.coalesce(F.array_join(line, "\n"), F.lit(""))), 256)
    rows = findings.join(per, [review, "code"], "left").select(review, F.struct("code", own.alias("own")).alias("f"))
    parts = rows.groupBy(review).agg(F.sort_array(F.collect_list("f")).alias("f"), F.count("*").alias("findings"))
    return parts.select(review, "findings", F.sha2(F.array_join(F.transform("f", lambda f: f["own"]), ","), 256).alias("digest"))


def manifest(specified: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, verdict): specified and covered, specified but not listed, or listed without being specified."""
    s, m = specified.select(key).distinct().withColumn("s", F.lit(True)), listed.select(key).distinct().withColumn("m", F.lit(True))
    verdict = F.when(F.col("m").isNull(), "not listed").when(F.col("s").isNull(), "not specified").otherwise("covered")
    return s.join(m, key, "full_outer").select(key, verdict.alias("verdict"))
