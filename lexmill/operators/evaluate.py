"""The two evaluators: numeric comparison of scoped caps, and presence. Both fail closed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.vocab import ROLL_UP, RULE_OUTCOMES

NA = "NOT_APPLICABLE"
VERSIONS = {"NUMERIC_COMPARISON": "numeric-1", "PRESENCE": "presence-1"}
#: Columns that the numeric evaluator reads of each cap, of the standard and of the rule.
CAP_COLUMNS = ("kind", "scope", "scope_label", "status", "value", "unit", "basis")
STANDARD_COLUMNS = ("std_scope", "std_unit", "std_basis", "preferred")
RULE_COLUMNS = ("has_rule", "scope_required", "comparable_scopes", "comparable_bases", "deviation_outcome", "unlimited_outcome", "approval_required_above", "acceptable_max")


def valid_outcome(value: Column) -> Column:
    """A configured outcome, or not applicable where it is absent or none of the known ones."""
    return F.when(value.isin(*RULE_OUTCOMES), value).otherwise(F.lit(NA))


def deviation_outcome(value: Column) -> Column:
    """What a rule says of a value that differs from the preferred one. The blanket outcome comes before thresholds."""
    above, most = F.col("approval_required_above"), F.col("acceptable_max")
    return (
        F.when(~F.coalesce(F.col("has_rule"), F.lit(False)), F.lit(NA))
        .when(F.col("deviation_outcome").isNotNull(), valid_outcome(F.col("deviation_outcome")))
        .when(value > above, F.lit("APPROVAL_REQUIRED"))
        .when(value <= most, F.lit("ACCEPTABLE"))
        .when(value > most, F.lit("APPROVAL_REQUIRED"))
        .otherwise(F.lit(NA))
    )


def comparable(own: Column, standard: Column, listed: Column) -> Column:
    """Whether two scopes or bases may be compared: equal, or listed; never if either is unknown."""
    return F.coalesce((own == standard) | (standard.isNotNull() & F.array_contains(F.coalesce(listed, F.array().cast("array<string>")), own)), F.lit(False))


def ladder() -> Column:
    """struct(classification, rule_outcome) of one cap: the first rung that holds decides."""

    def rung(classification: str, outcome: Column | str = NA) -> Column:
        out = F.lit(outcome) if isinstance(outcome, str) else outcome
        return F.struct(F.lit(classification).alias("classification"), out.alias("rule_outcome"))

    c = F.col
    unable = rung("UNABLE_TO_EVALUATE")
    unlimited = F.when(F.coalesce(c("has_rule"), F.lit(False)), valid_outcome(c("unlimited_outcome"))).otherwise(F.lit(NA))
    return (
        F.when((c("scope") == "UNKNOWN") & F.coalesce(c("scope_required"), F.lit(True)), unable)
        .when(c("status") == "UNKNOWN", unable)
        .when(c("status") == "UNLIMITED", rung("DEVIATION", unlimited))
        .when(c("status") == "ABSENT", rung("MISSING"))
        .when(c("value").isNull() | c("unit").isNull(), unable)
        .when(~comparable(c("scope"), c("std_scope"), c("comparable_scopes")), unable)
        .when(~c("unit").eqNullSafe(c("std_unit")), unable)
        .when(~comparable(c("basis"), c("std_basis"), c("comparable_bases")) | c("basis").isNull(), unable)
        .when(c("preferred").isNull(), unable)
        .when(c("value") == c("preferred"), rung("MATCH"))
        .otherwise(rung("DEVIATION", deviation_outcome(c("value"))))
    )


def same_scope(caps: DataFrame, keys: list[str], evidence: str = "evidence_id", order: str | None = None) -> DataFrame:
    """One row per key, kind, scope and label: the position it states, how many differ, and all evidence.

    Restatements of one position merge; several positions are a conflict. Positions are compared as structs, so that
    nulls are values like any other. Evidence is listed once each, in the order in which it was first seen if a column
    tells that, else by id.
    """
    grouped = caps.withColumn("__label", F.coalesce("scope_label", F.lit("")))
    position = F.struct("status", "value", "unit", "basis")
    listed = F.sort_array(F.collect_set(evidence))
    if order:
        listed = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(order, evidence))), lambda x: x[evidence]))
    per = grouped.groupBy(*keys, "kind", "scope", "__label").agg(
        F.collect_set(position).alias("__positions"), F.first("scope_label", ignorenulls=True).alias("scope_label"), listed.alias("evidence")
    )
    return per.select(*keys, "kind", "scope", "scope_label", F.size("__positions").alias("positions"), "evidence", F.col("__positions")[0].alias("p")).select(*keys, "kind", "scope", "scope_label", "positions", "evidence", "p.*")


def evaluate_numeric(subjects: DataFrame, caps: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Every numeric evaluation of subjects (keys, settings, facts_status, candidates): keys, evaluation_kind, scope_key,
    scope_label, classification, rule_outcome, evidence and its relation.

    Null facts and failed extraction give one row that could not be evaluated, with the candidates as evidence; facts
    without caps give one missing row without evidence. Columns of subjects named in carry come along.
    """
    own = caps.groupBy(*keys).agg(F.collect_list(F.struct(*CAP_COLUMNS, "evidence_id")).alias("caps"))
    return judged(subjects.join(own, keys, "left"), keys, carry)


def _scopes(caps: Column) -> Column:
    """array with a struct for each kind, scope and label of an array of caps: whether it states several positions, one of
    them, and the evidence by id."""
    scope = lambda c: F.struct(c["kind"].alias("kind"), c["scope"].alias("scope"), F.coalesce(c["scope_label"], F.lit("")).alias("label"))
    position = lambda c: F.struct(*[c[n].alias(n) for n in ("status", "value", "unit", "basis")])

    def summed(of: Column, own: Column) -> Column:
        ends = F.array(F.struct(F.array_min(F.transform(own, position)).alias("first"), F.array_max(F.transform(own, position)).alias("last")))
        label = F.get(F.array_compact(F.transform(own, lambda c: c["scope_label"])), 0)
        evidence = F.sort_array(F.array_distinct(F.array_compact(F.transform(own, lambda c: c["evidence_id"]))))
        one = lambda e: F.struct(of["kind"].alias("kind"), of["scope"].alias("scope"), label.alias("scope_label"), (~e["first"].eqNullSafe(e["last"])).alias("several"), e["first"].alias("p"), evidence.alias("evidence"))
        return F.get(F.transform(ends, one), 0)

    met = F.transform(F.array_distinct(F.transform(caps, scope)), lambda k: F.struct(k.alias("k"), F.filter(caps, lambda c: scope(c).eqNullSafe(k)).alias("own")))
    return F.transform(met, lambda m: summed(m["k"], m["own"]))


def judged(rows: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """As evaluate_numeric, of subjects that have their caps with them: caps, an array of caps with evidence_id, null or
    empty for none.

    Rows stay where they are: caps of one scope meet within their subject's row.
    """
    carry = carry or []
    readable = F.coalesce((F.col("facts_status") != "FAILED"), F.lit(False))
    each = rows.select(*keys, *STANDARD_COLUMNS, *RULE_COLUMNS, "candidates", *carry, readable.alias("readable"), F.explode_outer(F.when(readable, _scopes(F.col("caps")))).alias("cap"))
    flat = each.select(*[c for c in each.columns if c != "cap"], *[F.col(f"cap.{n}").alias(n) for n in ("kind", "scope", "scope_label", "several", "evidence")], "cap.p.*")
    rung = lambda name: F.struct(F.lit(name).alias("classification"), F.lit(NA).alias("rule_outcome"))
    none = F.array().cast("array<string>")
    result = F.when(~F.col("readable"), rung("UNABLE_TO_EVALUATE")).when(F.col("kind").isNull(), rung("MISSING")).when(F.col("several"), rung("CONFLICT")).otherwise(ladder())
    out = flat.withColumn("r", result).select(
        *keys, F.coalesce("kind", F.lit("PRIMARY")).alias("evaluation_kind"), F.coalesce("scope", F.nullif("std_scope", F.lit("")), F.lit("UNKNOWN")).alias("scope_key"), "scope_label", "r.classification", "r.rule_outcome",
        F.coalesce(F.when(F.col("readable"), F.col("evidence")).otherwise(F.col("candidates")), none).alias("evidence"), F.when(F.col("several"), "CONFLICTING").otherwise("PRIMARY").alias("relation"), *carry,
    )
    return stamp(out, "NUMERIC_COMPARISON")


def presence_result() -> Column:
    """struct(classification, rule_outcome, actual) from mapping_state, expected_presence, required and the rule.

    Null for an optional requirement that nothing maps to: it has no row.
    """
    c = F.col
    ok = F.when(F.coalesce(c("has_rule"), F.lit(False)), F.lit("ACCEPTABLE")).otherwise(F.lit(NA))
    departs = F.when(F.coalesce(c("has_rule"), F.lit(False)), valid_outcome(c("deviation_outcome"))).otherwise(F.lit(NA))

    def row(classification: str, outcome: Column, actual: str) -> Column:
        return F.struct(F.lit(classification).alias("classification"), outcome.alias("rule_outcome"), F.lit(actual).alias("actual"))

    return (
        F.when((c("mapping_state") == "CONFIRMED") & (c("expected_presence") == "PRESENT"), row("MATCH", ok, "PRESENT"))
        .when(c("mapping_state") == "CONFIRMED", row("DEVIATION", departs, "PRESENT"))
        .when((c("mapping_state") == "NONE") & (c("expected_presence") == "ABSENT"), row("MATCH", ok, "ABSENT"))
        .when((c("mapping_state") == "NONE") & c("required"), row("MISSING", F.lit(NA), "ABSENT"))
        .when(c("mapping_state") == "NONE", F.lit(None))
        .otherwise(row("UNABLE_TO_EVALUATE", F.lit(NA), "INDETERMINATE"))
    )


def evaluate_presence(subjects: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Presence evaluations of subjects (keys, mapping_state, expected_presence, required, rule, candidates); columns of
    subjects named in carry come along.

    Subjects without an expectation or a mapping are misconfigured and have no row here; see misconfigured().
    """
    rows = subjects.filter(F.col("expected_presence").isNotNull() & F.col("mapping_state").isNotNull()).withColumn("r", presence_result()).filter("r is not null")
    none = F.array().cast("array<string>")
    return stamp(
        rows.select(
            *keys, F.lit("PRIMARY").alias("evaluation_kind"), F.coalesce(F.nullif(F.col("std_scope"), F.lit("")), F.lit("DEFAULT")).alias("scope_key"), F.lit(None).cast("string").alias("scope_label"),
            "r.classification", "r.rule_outcome", F.when(F.col("mapping_state") == "NONE", none).otherwise(F.coalesce("candidates", none)).alias("evidence"), F.lit("PRIMARY").alias("relation"), *(carry or []),
        ),
        "PRESENCE",
    )


def misconfigured(subjects: DataFrame) -> DataFrame:
    """Presence subjects that may not be evaluated, with the reason."""
    reason = F.when(F.col("expected_presence").isNull(), "no expected_presence").when(F.col("mapping_state").isNull(), "no mapping")
    return subjects.withColumn("failure", reason).filter("failure is not null")


def stamp(rows: DataFrame, kind: str) -> DataFrame:
    return rows.withColumn("evaluator_version", F.lit(VERSIONS[kind]))


#: Evaluators by type: the only point of extension.
REGISTRY: dict[str, Callable] = {"NUMERIC_COMPARISON": evaluate_numeric, "PRESENCE": evaluate_presence}


def applicability(value: Column) -> Column:
    """struct(required, diagnostic): REQUIRED or OPTIONAL; anything else counts as required and is noted."""
    known = value.isin("REQUIRED", "OPTIONAL")
    return F.struct((~F.coalesce(value == "OPTIONAL", F.lit(False))).alias("required"), F.when(F.coalesce(known, F.lit(False)), F.lit(None).cast("string")).otherwise("applicability not declared").alias("diagnostic"))


def rank(classification: Column) -> Column:
    """Place in the roll-up order, 0 first."""
    return F.array_position(F.array(*[F.lit(c) for c in ROLL_UP]), classification).cast("int") - 1


def evidence_violation(classification: Column, evidence: Column) -> Column:
    """Whether an evaluation lacks evidence that it must have: only a missing one may have none."""
    return (F.size(evidence) == 0) & (classification != "MISSING")
