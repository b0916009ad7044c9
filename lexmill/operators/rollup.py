"""Roll-ups from evaluations to findings, decisions and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.functions.vocab import TIER_1
from lexmill.operators.evaluate import rank


def finding_classification(evaluations: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The first classification in roll-up order of each finding, how many evaluations it has, and more aggregates."""
    first = F.min_by("classification", rank(F.col("classification"))).alias("classification")
    return evaluations.groupBy(*keys).agg(first, F.count("*").alias("evaluations"), *more)


def nothing_to_roll_up(findings: DataFrame, evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """Findings without evaluations, which have no classification and are an error, with the reason."""
    return findings.join(evaluations.select(*keys), keys, "left_anti").select(*keys, F.lit("no evaluations to roll up").alias("failure"))


def tier(classification: Column) -> Column:
    return F.when(classification.isin(*TIER_1), 1).otherwise(2)


def requires_decision(classification: Column, outcome: Column, required: Column, escalated: Column) -> Column:
    """Whether a person has to decide on an evaluation."""
    return (
        outcome.isin("APPROVAL_REQUIRED", "UNACCEPTABLE") | classification.isin(*TIER_1) | ((classification == "MISSING") & required)
        | ((classification == "DEVIATION") & (outcome == "NOT_APPLICABLE")) | F.coalesce(escalated, F.lit(False))
    )


def current_decision(decisions: DataFrame, evaluation: str, version: str = "version_number") -> DataFrame:
    """The decision of the highest version of each evaluation."""
    others = [c for c in decisions.columns if c != evaluation]
    return decisions.groupBy(evaluation).agg(F.max_by(F.struct(*others), version).alias("d")).select(evaluation, "d.*")


def decision_history(decisions: DataFrame, evaluation: str, version: str = "version_number") -> DataFrame:
    """All versions with is_current."""
    top = F.max(version).over(W.partitionBy(evaluation))
    return decisions.withColumn("is_current", F.col(version) == top)


def decision_effective(decisions: DataFrame, evaluation: str, two_person: str, version: str = "version_number", kind: str = "decision_type", actor: str = "decided_by") -> DataFrame:
    """Per evaluation whether its last decision is in force.

    A decision of the two_person type needs the version before it to be of the same type by someone else.
    """
    w = W.partitionBy(evaluation).orderBy(version)
    seen = decisions.withColumn("__kind", F.lag(kind).over(w)).withColumn("__actor", F.lag(actor).over(w)).withColumn("__last", F.lead(version).over(w).isNull())
    second = (F.col("__kind") == F.col(kind)) & (F.col("__actor") != F.col(actor))
    return seen.filter("__last").select(evaluation, F.col(version).alias("version_number"), F.col(kind).alias("decision_type"), ((F.col(kind) != two_person) | F.coalesce(second, F.lit(False))).alias("effective"))


def finding_status(evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each finding from (requires, decision_type) of its evaluations, and whether it is resolved.

    Clarification asked comes before a missing decision, that before resolved; nothing required leaves it open.
    """
    open_ = F.col("requires") & F.col("decision_type").isNull()
    asked = F.col("requires") & F.coalesce(F.col("decision_type") == "REQUEST_CLARIFICATION", F.lit(False))
    settled = ~F.col("requires") | (F.col("decision_type").isNotNull() & (F.col("decision_type") != "REQUEST_CLARIFICATION"))
    per = evaluations.groupBy(*keys).agg(F.bool_or(asked).alias("a"), F.bool_or(open_).alias("o"), F.bool_or("requires").alias("r"), F.bool_and(F.coalesce(settled, F.lit(False))).alias("resolved"))
    status = F.when(F.col("a"), "AWAITING_CLARIFICATION").when(F.col("o"), "DECISION_REQUIRED").when(F.col("r"), "RESOLVED").otherwise("OPEN")
    return per.select(*keys, status.alias("status"), "resolved", F.col("r").alias("requires_decision"))


def review_outcome(findings: DataFrame, reviews: DataFrame, review: str) -> DataFrame:
    """reviews with requires_legal, decisions_complete and the status after analysis.

    A review without findings requires nothing and is complete.
    """
    per = findings.groupBy(review).agg(F.bool_or("requires_decision").alias("legal"), F.bool_and(F.col("resolved") | ~F.col("requires_decision")).alias("complete"))
    rows = reviews.join(per, review, "left")
    legal, complete = F.coalesce("legal", F.lit(False)), F.coalesce("complete", F.lit(True))
    return rows.withColumn("requires_legal", legal).withColumn("decisions_complete", complete).withColumn("next_status", F.when(F.col("requires_legal"), "LEGAL_REVIEW").otherwise("RESOLVED")).drop("legal", "complete")


def fail_closed_rate(rows: DataFrame) -> DataFrame:
    """Share of first-tier classifications, to four digits; null for none."""
    n = F.count_if(F.col("classification").isin(*TIER_1))
    return rows.agg(F.bround(F.try_divide(n.cast("double"), F.count("*").cast("double")), 4).alias("fail_closed_rate"), F.count("*").alias("total"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def signal_name(classification: Column) -> Column:
    """The metric a classification counts towards."""
    return F.when(classification.isin(*TIER_1), "analysis.fail_closed_rate").otherwise("analysis.classification_count")


def operational_failure(review_status: Column) -> Column:
    """Only a failed analysis is one; no classification ever is."""
    return F.coalesce(review_status == "ANALYSIS_FAILED", F.lit(False))
