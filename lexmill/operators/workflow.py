"""Review lifecycle, decisions, escalations and versions as checks over relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.functions.text import strip
from lexmill.functions.vocab import DECISION_TYPES, TRANSITIONS


def transition_allowed(before: Column, after: Column) -> Column:
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    return F.coalesce(F.array_contains(pairs, F.concat(before, F.lit(">"), after)), F.lit(False))


def lifecycle_walk(status: Column) -> Column:
    """The moves a review makes before its analysis: on to PROCESSING, from wherever it stands on that way."""
    return F.when(status == "DRAFT", F.array(F.lit("UPLOADED"), F.lit("PROCESSING"))).when(status == "UPLOADED", F.array(F.lit("PROCESSING"))).otherwise(F.array().cast("array<string>"))


def may_resolve(status: Column, complete: Column) -> Column:
    """Whether a review may become RESOLVED: the move exists and all decisions are made."""
    return transition_allowed(status, F.lit("RESOLVED")) & F.coalesce(complete, F.lit(True))


def next_version(rows: DataFrame, parent: list[str], version: str = "version_number") -> DataFrame:
    """The number that the next version of each parent takes."""
    return rows.groupBy(*parent).agg((F.coalesce(F.max(version), F.lit(0)) + 1).cast("long").alias("next_version"))


def latest(rows: DataFrame, parent: list[str], version: str = "version_number") -> DataFrame:
    """The row of the highest version of each parent."""
    others = [c for c in rows.columns if c not in parent]
    return rows.groupBy(*parent).agg(F.max_by(F.struct(*others), version).alias("v")).select(*parent, "v.*")


def latest_completed(runs: DataFrame, parent: str, status: str, started: str, created: str, id_: str) -> DataFrame:
    """The last completed run of each parent: by start (unknown ones last), creation, id."""
    w = W.partitionBy(parent).orderBy(F.col(started).desc_nulls_last(), F.col(created).desc(), F.col(id_).desc())
    return runs.filter(F.col(status) == "COMPLETED").withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def first_of(rows: DataFrame, parent: list[str], *order: Column) -> DataFrame:
    w = W.partitionBy(*parent).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def record_decisions(commands: DataFrame, decisions: DataFrame, grants: DataFrame) -> DataFrame:
    """commands with the reason of refusal, or null and the version they are stored as.

    In this order: unknown type, missing permission (customizations need a second one), blank justification, a stale
    expected version, and a rival command for the same version.
    """
    versions = next_version(decisions, ["evaluation_id"]).withColumnRenamed("next_version", "__next")
    held = grants.groupBy("user_id").agg(F.collect_set("permission").alias("__held"))
    rows = commands.join(versions, "evaluation_id", "left").join(held, "user_id", "left").withColumn("version_number", F.coalesce("__next", F.lit(1)).cast("long"))
    has = lambda p: F.coalesce(F.array_contains("__held", p), F.lit(False))
    reason = (
        F.when(~F.col("decision_type").isin(*DECISION_TYPES), "unknown type")
        .when(~has("decision.create"), "forbidden")
        .when((F.col("decision_type") == "APPROVE_CUSTOMIZATION") & ~has("customization.approve"), "forbidden")
        .when(F.coalesce(strip(F.col("justification")), F.lit("")) == "", "no justification")
        .when(F.col("expected_version").isNotNull() & (F.col("expected_version") != F.col("version_number")), "stale version")
    )
    rows = rows.withColumn("refused", reason)
    first = F.row_number().over(W.partitionBy("evaluation_id", F.col("refused").isNull()).orderBy("command_id"))
    rows = rows.withColumn("refused", F.when(F.col("refused").isNull() & (first > 1), "version taken").otherwise(F.col("refused")))
    return rows.withColumn("version_number", F.when(F.col("refused").isNull(), F.col("version_number"))).drop("__next", "__held")


def active_escalations(escalations: DataFrame) -> DataFrame:
    return escalations.filter(F.col("withdrawn_at").isNull())


def escalate(requests: DataFrame, escalations: DataFrame) -> DataFrame:
    """The requests that open a new escalation: a finding that has an active one keeps it."""
    return requests.join(active_escalations(escalations).select("finding_id"), "finding_id", "left_anti").dropDuplicates(["finding_id"])


def withdraw(escalations: DataFrame, findings: DataFrame, at: Column) -> DataFrame:
    """escalations with the active ones of those findings ended; nothing is deleted."""
    hit = findings.select("finding_id").distinct().withColumn("__hit", F.lit(True))
    rows = escalations.join(hit, "finding_id", "left")
    return rows.withColumn("withdrawn_at", F.when(F.col("__hit") & F.col("withdrawn_at").isNull(), at).otherwise(F.col("withdrawn_at"))).drop("__hit")


def analysis_refusal(clauses: Column, document_type_known: Column, untyped_items: Column) -> Column:
    """Why an analysis does not begin, the first reason that holds; null where it may."""
    return F.when(clauses == 0, "no clauses").when(~document_type_known, "document type not declared").when(untyped_items > 0, "untyped snapshot")


def outstanding(evaluations: DataFrame, decisions: DataFrame) -> DataFrame:
    """How many required decisions are missing, and since when."""
    open_ = evaluations.filter("requires").join(decisions.select("evaluation_id").distinct(), "evaluation_id", "left_anti")
    return open_.agg(F.count("*").alias("outstanding"), F.min("created_at").alias("oldest"))
