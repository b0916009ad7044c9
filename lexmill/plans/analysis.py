"""The whole analysis as one plan: clauses and a snapshot in, evaluations, findings and review states out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import normalize
from lexmill.operators import evaluate, extract, mapping, rollup, workflow


@dataclass(frozen=True, kw_only=True)
class Requirement:
    """One item of a snapshot: how to find it, what is wanted of it, and what departures mean."""

    rules: mapping.Rules
    evaluator_type: str = "NUMERIC_COMPARISON"
    document_type: str = "MSA"
    required: bool = True
    expected_presence: str | None = None
    preferred: float | None = None
    unit: str | None = None
    basis: str | None = None
    scope_key: str | None = None
    terms: extract.Terms = field(default_factory=extract.Terms)
    has_rule: bool = False
    deviation_outcome: str | None = None
    unlimited_outcome: str | None = None
    approval_required_above: float | None = None
    acceptable_max: float | None = None
    scope_required: bool = True
    comparable_scopes: Sequence[str] = ()
    comparable_bases: Sequence[str] = ()

    @property
    def code(self) -> str:
        return self.rules.code


SETTINGS = "requirement string, document_type string, required boolean, expected_presence string, std_scope string, std_unit string, std_basis string, preferred double, has_rule boolean, scope_required boolean, comparable_scopes array<string>, comparable_bases array<string>, deviation_outcome string, unlimited_outcome string, approval_required_above double, acceptable_max double"


def settings(spark, snapshot: Sequence[Requirement]) -> DataFrame:
    """The snapshot as a relation; it is configuration, a few hundred rows."""
    return spark.createDataFrame(
        [
            (r.code, r.document_type, r.required, r.expected_presence, r.scope_key, r.unit, r.basis, r.preferred, r.has_rule, r.scope_required, list(r.comparable_scopes), list(r.comparable_bases), r.deviation_outcome, r.unlimited_outcome, r.approval_required_above, r.acceptable_max)
            for r in snapshot
        ],
        SETTINGS,
    )


def refusals(clauses: DataFrame, snapshot: Sequence[Requirement]) -> DataFrame:
    """(review_id, refusal) of the reviews whose analysis may not begin: no clauses, a document type that is not
    declared, or a snapshot with an item of no known type."""
    untyped = sum(not r.document_type for r in snapshot)
    per = clauses.groupBy("review_id").agg(F.count("content").alias("n"), F.bool_and(F.col("document_type").isNotNull()).alias("declared"))
    return per.select("review_id", workflow.analysis_refusal(F.col("n"), F.col("declared"), F.lit(untyped)).alias("refusal")).filter("refusal is not null")


def reading(body: Column, said: Column, terms: Column, evidence: Column) -> list[Column]:
    """What one clause says, as columns that told() sums up: usable, blank, caps. said: whether the clause is one of those
    asked; blank and caps are null where it is not."""
    caps = F.transform(extract.caps_by(body, terms), lambda c: F.struct(*[c[n].alias(n) for n in evaluate.CAP_COLUMNS], evidence.alias("evidence_id")))
    return [F.coalesce(terms["usable"], F.lit(False)).alias("usable"), F.when(said, body == "").alias("blank"), F.when(said, caps).alias("caps")]


def told() -> list[Column]:
    """Aggregates of the columns of reading()."""
    return [F.bool_or("usable").alias("usable"), F.count("blank").alias("read"), F.count_if("blank").alias("blank"), F.flatten(F.collect_list("caps")).alias("caps")]


def facts(rows: DataFrame) -> DataFrame:
    """rows with facts_status and caps instead of the aggregates of told()."""
    n = F.size("caps")
    status = (
        F.when(F.col("read") == 0, F.lit(None)).when(~F.col("usable"), "FAILED").when((n == 0) & (F.col("blank") == F.col("read")), "FAILED")
        .when((n > 0) & (F.col("blank") > 0), "PARTIAL").otherwise("COMPLETE")
    )
    return rows.withColumn("facts_status", status).drop("usable", "read", "blank")


def stated(states: DataFrame, clauses: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """states with what their confirmed clauses say: facts_status and caps, for states that come without their clauses. Each
    clause is fetched for the requirements that it confirms, and read by the terminology of that requirement, which is a
    row and does not travel to the clause.

    What clauses say comes together in one aggregate on (review, requirement), which all that follows keeps to. Standards
    may be joined after it, so that clauses are read once for however many of them.
    """
    carried = [c for c in states.columns if c not in keys]
    confirmed = F.when(F.col("mapping_state") == "CONFIRMED", F.col("evidence"))
    own = states.select(*keys, F.struct(*carried).alias("s"), F.explode_outer(confirmed).alias("evidence_id"))
    read = own.join(clauses.select("review_id", "evidence_id", "content"), ["review_id", "evidence_id"], "left").withColumn("body", normalize(F.col("content"))).join(F.broadcast(terms), "requirement", "left")
    found = read.select(*keys, "s", *reading(F.col("body"), F.col("content").isNotNull(), F.col("terms"), F.col("evidence_id")))
    return facts(found.groupBy(*keys).agg(F.first("s").alias("s"), *told()).select(*keys, "s.*", "usable", "read", "blank", "caps"))


def run_analysis(clauses: DataFrame, snapshot: Sequence[Requirement]) -> dict[str, DataFrame]:
    """Relations of an analysis of clauses (review_id, document_type, evidence_id, content, section_title).

    evaluations and findings are what is stored; skipped lists optional requirements that nothing maps to; failures
    lists requirements that could not be evaluated as configured, so that one never stops the others: their settings and
    terms are data of one plan, and what is wrong with one of them is a row of its own. Nothing is kept in the session. refused lists reviews whose
    analysis does not begin; nothing else has rows of them. A numeric requirement with no mapped clause has no facts
    and no evidence: it is a failure and leaves no finding.
    """
    spark = clauses.sparkSession
    table = F.broadcast(settings(spark, snapshot))
    keys = ["review_id", "requirement"]
    refused = refusals(clauses, snapshot)
    # What refusals() names has no clause of a declared type, or the snapshot stops all. Only clauses of the
    # requirement's kind of document are tested.
    admitted = clauses.filter(F.col("document_type").isNotNull() & F.col("content").isNotNull() & F.lit(all(r.document_type for r in snapshot)))
    scored = mapping.score(admitted, [r.rules for r in snapshot], "content", "section_title", signals=False, only=[F.col("document_type") == r.document_type for r in snapshot], keep="body")

    def states_of(rows: DataFrame, *more: Column) -> DataFrame:
        own = mapping.state(rows, ["review_id"], F.col("evidence_id"), *more).join(table, "requirement")
        return own.withColumn("mapping_state", F.col("state")).withColumn("candidates", F.col("evidence"))

    states = states_of(scored)
    carry = ["mapping_state", "required"]
    present = states.filter(F.col("requirement").isin([r.code for r in snapshot if r.evaluator_type == "PRESENCE"]))
    found = evaluate.REGISTRY["PRESENCE"](present, keys, carry)
    skipped = present.filter("mapping_state = 'NONE' and expected_presence = 'PRESENT' and not required").select(*keys)
    failures = evaluate.misconfigured(present).select(*keys, "failure")
    known = set(evaluate.REGISTRY)
    if odd := [r.code for r in snapshot if r.evaluator_type not in known]:
        failures = failures.unionByName(states.filter(F.col("requirement").isin(odd)).select(*keys, F.lit("unknown evaluator_type").alias("failure")))
    if numeric := [r for r in snapshot if r.evaluator_type == "NUMERIC_COMPARISON"]:
        # A clause at the threshold confirms its requirement and is its evidence, so it is read where it was scored.
        terms = F.broadcast(extract.term_rows(spark, {r.code: r.terms for r in numeric}))
        confirms = (F.col("score") >= F.col("threshold")) & F.col("review_id").isNotNull() & F.col("evidence_id").isNotNull()
        asked = scored.join(terms, "requirement")
        rows = states_of(asked.select("review_id", "requirement", "threshold", "score", "evidence_id", *reading(F.col("body"), confirms, F.col("terms"), F.col("evidence_id").cast("string"))), *told())
        # A requirement with an evaluation that lacks its evidence leaves none. What was read names its clauses, so only a
        # subject that could not be read lacks any, and that has one row.
        rows = evaluate.judged(facts(rows), keys, carry).withColumn("bad", evaluate.evidence_violation(F.col("classification"), F.col("evidence")))
        failures = failures.unionByName(rows.filter("bad").select(*keys, F.lit("evaluation without evidence").alias("failure")).distinct())
        found = found.unionByName(rows.filter("not bad").drop("bad"))
    evaluations = found.withColumn("requires", rollup.requires_decision(F.col("classification"), F.col("rule_outcome"), F.col("required"), F.lit(False)))
    findings = rollup.finding_classification(evaluations, keys, F.bool_or("requires").alias("requires_decision"))
    reviews = admitted.select("review_id").distinct()
    review = rollup.review_outcome(findings.withColumn("resolved", ~F.col("requires_decision")), reviews, "review_id")
    return {"states": states, "evaluations": evaluations, "findings": findings, "skipped": skipped, "failures": failures, "refused": refused, "reviews": review}
