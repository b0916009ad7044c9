"""Decisions, findings, reviews and their lifecycle: orders stand for reviews, line items for evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import invariants, report, rollup, workflow
from lexmill.plans.q_evaluation import EVALS, TIER1, _split, evaluations
from lexmill.plans.registry import query, table
from lexmill.streaming import rate_limit

#: Line numbers stand for versions of one order's decision.
DECISIONS = "SELECT l_orderkey AS evaluation_id, CAST(l_linenumber AS BIGINT) * 100000000 + l_suppkey * 20000 + l_partkey AS version_number, CASE l_returnflag WHEN 'R' THEN 'REJECT' WHEN 'A' THEN 'REQUEST_CLARIFICATION' ELSE 'APPROVE_CUSTOMIZATION' END AS decision_type, l_suppkey % 3 AS decided_by FROM lineitem"
REQUIRES = f"(rule_outcome IN ('APPROVAL_REQUIRED', 'UNACCEPTABLE') OR {TIER1} OR (classification = 'MISSING' AND required) OR (classification = 'DEVIATION' AND rule_outcome = 'NOT_APPLICABLE'))"
#: Every third order has escalated evaluations of even number; an evaluation is decided where its supplier is.
WORK = f"SELECT e.*, {REQUIRES} OR (finding_id % 3 = 0 AND evaluation_no % 2 = 0) AS requires, CASE actor % 4 WHEN 0 THEN 'REQUEST_CLARIFICATION' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'ACCEPT_DEVIATION' END AS decision_type FROM ({EVALS}) e"


def decisions(spark, d):
    return table(spark, d, "lineitem").selectExpr(*_split(DECISIONS.removeprefix("SELECT ").removesuffix(" FROM lineitem")))


def work(spark, d):
    escalated = (F.col("finding_id") % 3 == 0) & (F.col("evaluation_no") % 2 == 0)
    kind = F.when(F.col("actor") % 4 == 0, "REQUEST_CLARIFICATION").when(F.col("actor") % 4 == 1, "REJECT").when(F.col("actor") % 4 == 2, "ACCEPT_DEVIATION")
    return evaluations(spark, d).withColumn("requires", rollup.requires_decision(F.col("classification"), F.col("rule_outcome"), F.col("required"), escalated)).withColumn("decision_type", kind)


@query("decision_required", f"WITH w AS ({WORK}) SELECT finding_id, evaluation_no, requires FROM w")
def decision_required(spark, d):
    return work(spark, d).select("finding_id", "evaluation_no", "requires")


@query("decision_current", f"WITH v AS ({DECISIONS}) SELECT evaluation_id, max(version_number) AS version_number, arg_max(decision_type, version_number) AS decision_type, arg_max(decided_by, version_number) AS decided_by FROM v GROUP BY evaluation_id")
def decision_current(spark, d):
    return rollup.current_decision(decisions(spark, d), "evaluation_id")


@query("decision_history", f"WITH v AS ({DECISIONS}) SELECT *, version_number = max(version_number) OVER (PARTITION BY evaluation_id) AS is_current FROM v")
def decision_history(spark, d):
    return rollup.decision_history(decisions(spark, d), "evaluation_id")


@query("decision_effective", f"""WITH v AS ({DECISIONS}), w AS (SELECT *, lag(decision_type) OVER o AS before_type, lag(decided_by) OVER o AS before_actor, lead(version_number) OVER o AS later FROM v WINDOW o AS (PARTITION BY evaluation_id ORDER BY version_number))
SELECT evaluation_id, version_number, decision_type, decision_type <> 'APPROVE_CUSTOMIZATION' OR coalesce(before_type = decision_type AND before_actor <> decided_by, false) AS effective FROM w WHERE later IS NULL""")
def decision_effective(spark, d):
    return rollup.decision_effective(decisions(spark, d), "evaluation_id", "APPROVE_CUSTOMIZATION")


@query("decision_next_version", f"WITH v AS ({DECISIONS}) SELECT evaluation_id, max(version_number) + 1 AS next_version FROM v GROUP BY evaluation_id")
def decision_next_version(spark, d):
    return workflow.next_version(decisions(spark, d), ["evaluation_id"])


@query("decision_outstanding", f"WITH w AS ({WORK}) SELECT count(*) AS outstanding, strftime(min(o_orderdate), '%Y-%m-%d') AS oldest FROM w JOIN orders ON o_orderkey = finding_id WHERE requires AND (finding_id, evaluation_no) NOT IN (SELECT (finding_id, evaluation_no) FROM w WHERE decision_type IS NOT NULL)")
def decision_outstanding(spark, d):
    w, o = work(spark, d).withColumn("evaluation_id", F.concat_ws(":", "finding_id", "evaluation_no")), table(spark, d, "orders")
    rows = w.join(o, w["finding_id"] == o["o_orderkey"]).select("evaluation_id", "requires", F.col("o_orderdate").alias("created_at"))
    out = workflow.outstanding(rows, w.filter("decision_type is not null").select("evaluation_id"))
    return out.select("outstanding", F.date_format("oldest", "yyyy-MM-dd").alias("oldest"))


_STATUS = f"""w AS ({WORK}), s AS (SELECT finding_id, bool_or(requires AND coalesce(decision_type = 'REQUEST_CLARIFICATION', false)) AS a, bool_or(requires AND decision_type IS NULL) AS o, bool_or(requires) AS r,
bool_and(NOT requires OR coalesce(decision_type <> 'REQUEST_CLARIFICATION', false)) AS resolved FROM w GROUP BY finding_id),
f AS (SELECT finding_id, CASE WHEN a THEN 'AWAITING_CLARIFICATION' WHEN o THEN 'DECISION_REQUIRED' WHEN r THEN 'RESOLVED' ELSE 'OPEN' END AS status, resolved, r AS requires_decision FROM s)"""


@query("finding_status", f"WITH {_STATUS} SELECT finding_id, status FROM f")
def finding_status(spark, d):
    return rollup.finding_status(work(spark, d), ["finding_id"]).select("finding_id", "status")


@query("finding_resolved", f"WITH {_STATUS} SELECT finding_id, resolved, requires_decision FROM f")
def finding_resolved(spark, d):
    return rollup.finding_status(work(spark, d), ["finding_id"]).select("finding_id", "resolved", "requires_decision")


@query("review_advance", f"""WITH {_STATUS}, r AS (SELECT o_custkey AS review_id, coalesce(bool_or(requires_decision), false) AS requires_legal, coalesce(bool_and(resolved OR NOT requires_decision), true) AS decisions_complete FROM orders LEFT JOIN f ON finding_id = o_orderkey GROUP BY o_custkey)
SELECT *, CASE WHEN requires_legal THEN 'LEGAL_REVIEW' ELSE 'RESOLVED' END AS next_status FROM r""")
def review_advance(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("review_id"))
    f = rollup.finding_status(work(spark, d), ["finding_id"])
    return rollup.review_outcome(f.join(o, f["finding_id"] == o["o_orderkey"]), o.select("review_id").distinct(), "review_id")


_BEFORE = "CASE event_id % 9 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'UPLOADED' WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'ANALYSIS_COMPLETE' WHEN 4 THEN 'LEGAL_REVIEW' WHEN 5 THEN 'RESOLVED' WHEN 6 THEN 'CLOSED' WHEN 7 THEN 'ANALYSIS_FAILED' ELSE 'CANCELLED' END"
_AFTER = _BEFORE.replace("event_id", "user_id")


@query("lifecycle_valid", f"""WITH m AS (SELECT {_BEFORE} AS before, {_AFTER} AS after FROM events)
SELECT before, after, (before, after) IN (('DRAFT', 'UPLOADED'), ('DRAFT', 'CANCELLED'), ('UPLOADED', 'PROCESSING'), ('UPLOADED', 'CANCELLED'), ('PROCESSING', 'ANALYSIS_COMPLETE'), ('PROCESSING', 'ANALYSIS_FAILED'), ('ANALYSIS_COMPLETE', 'LEGAL_REVIEW'), ('ANALYSIS_COMPLETE', 'RESOLVED'), ('LEGAL_REVIEW', 'RESOLVED'), ('RESOLVED', 'CLOSED')) AS allowed, count(*) AS n FROM m GROUP BY before, after""")
def lifecycle_valid(spark, d):
    m = table(spark, d, "events").selectExpr(f"{_BEFORE} AS before", f"{_AFTER} AS after")
    return m.groupBy("before", "after").agg(F.count("*").alias("n")).withColumn("allowed", workflow.transition_allowed(F.col("before"), F.col("after")))


@query("lifecycle_walk", f"WITH m AS (SELECT DISTINCT {_BEFORE} AS before FROM events) SELECT before, CASE before WHEN 'DRAFT' THEN 'UPLOADED,PROCESSING' WHEN 'UPLOADED' THEN 'PROCESSING' ELSE '' END AS walk, before IN ('ANALYSIS_COMPLETE', 'LEGAL_REVIEW') AS may_resolve FROM m")
def lifecycle_walk(spark, d):
    m = table(spark, d, "events").selectExpr(f"{_BEFORE} AS before").distinct()
    return m.select("before", F.array_join(workflow.lifecycle_walk(F.col("before")), ",").alias("walk"), workflow.may_resolve(F.col("before"), F.lit(True)).alias("may_resolve"))


@query("latest_completed_run", """WITH r AS (SELECT user_id, event_id, ts AS created_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS started_at FROM events WHERE event_type = 'purchase')
SELECT user_id, event_id FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC NULLS LAST, created_at DESC, event_id DESC) = 1""")
def latest_completed_run(spark, d):
    runs = table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("created_at"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("started_at"), F.when(F.col("event_type") == "purchase", "COMPLETED").otherwise("FAILED").alias("status"))
    return workflow.latest_completed(runs, "user_id", "status", "started_at", "created_at", "event_id").select("user_id", "event_id")


@query("review_first", "SELECT o_custkey, o_orderstatus, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_review FROM orders GROUP BY o_custkey, o_orderstatus")
def review_first(spark, d):
    o = table(spark, d, "orders")
    return workflow.first_of(o, ["o_custkey", "o_orderstatus"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("first_review"))


@query("decision_commands", f"""WITH v AS ({DECISIONS}), n AS (SELECT evaluation_id, max(version_number) + 1 AS next FROM v GROUP BY evaluation_id),
c AS (SELECT o_orderkey AS command_id, o_orderkey // 3 AS evaluation_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'APPROVE_CUSTOMIZATION' WHEN 'F' THEN 'REJECT' ELSE 'WHIM' END AS decision_type, CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE 'because' END AS justification, CASE WHEN o_orderkey % 5 = 0 THEN 2 END AS expected_version FROM orders),
p AS (SELECT c.*, coalesce(next, 1) AS version_number, user_id % 4 < 3 AS may, user_id % 4 < 2 AS customize FROM c LEFT JOIN n USING (evaluation_id)),
q AS (SELECT *, CASE WHEN decision_type = 'WHIM' THEN 'unknown type' WHEN NOT may OR (decision_type = 'APPROVE_CUSTOMIZATION' AND NOT customize) THEN 'forbidden' WHEN trim(justification) = '' THEN 'no justification' WHEN expected_version <> version_number THEN 'stale version' END AS refused FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY evaluation_id, refused IS NULL ORDER BY command_id) AS k FROM q)
SELECT command_id, CASE WHEN refused IS NULL AND k > 1 THEN 'version taken' ELSE refused END AS refused, CASE WHEN refused IS NULL AND k = 1 THEN CAST(version_number AS BIGINT) ELSE 0 END AS version_number FROM r""")
def decision_commands(spark, d):
    kind = F.when(F.col("o_orderstatus") == "O", "APPROVE_CUSTOMIZATION").when(F.col("o_orderstatus") == "F", "REJECT").otherwise("WHIM")
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("command_id"), F.expr("o_orderkey div 3").alias("evaluation_id"), F.col("o_custkey").alias("user_id"), kind.alias("decision_type"), F.when(F.col("o_orderkey") % 7 == 0, "  ").otherwise("because").alias("justification"), F.when(F.col("o_orderkey") % 5 == 0, 2).alias("expected_version"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    grants = users.filter("user_id % 4 < 3").withColumn("permission", F.lit("decision.create")).union(users.filter("user_id % 4 < 2").withColumn("permission", F.lit("customization.approve")))
    return workflow.record_decisions(c, decisions(spark, d), grants).select("command_id", "refused", F.coalesce("version_number", F.lit(0)).cast("long").alias("version_number"))


_ESC = "SELECT event_id AS escalation_id, user_id AS finding_id, CASE WHEN event_type = 'view' AND value > 60 THEN NULL ELSE value END AS withdrawn_at FROM events"


@query("escalation_requests", f"WITH e AS ({_ESC}) SELECT DISTINCT c_custkey AS finding_id FROM customer WHERE c_custkey NOT IN (SELECT finding_id FROM e WHERE withdrawn_at IS NULL)")
def escalation_requests(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("escalation_id"), F.col("user_id").alias("finding_id"), F.when((F.col("event_type") != "view") | (F.col("value") <= 60), F.col("value")).alias("withdrawn_at"))
    return workflow.escalate(table(spark, d, "customer").select(F.col("c_custkey").alias("finding_id")), e)


@query("escalation_withdraw", f"WITH e AS ({_ESC}) SELECT escalation_id, CASE WHEN withdrawn_at IS NULL AND finding_id % 2 = 0 THEN -1.0 ELSE withdrawn_at END AS withdrawn_at FROM e")
def escalation_withdraw(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("escalation_id"), F.col("user_id").alias("finding_id"), F.when((F.col("event_type") != "view") | (F.col("value") <= 60), F.col("value")).alias("withdrawn_at"))
    return workflow.withdraw(e, e.filter("finding_id % 2 = 0"), F.lit(-1.0)).select("escalation_id", "withdrawn_at")


@query("analysis_refusal", "WITH r AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, lang FROM documents) SELECT doc_id, CASE WHEN n < 4 THEN 'no clauses' WHEN lang NOT IN ('en', 'fr') THEN 'document type not declared' WHEN doc_id % 5 > 3 THEN 'untyped snapshot' END AS refusal FROM r")
def analysis_refusal(spark, d):
    n = F.size(F.split("text", "\n", -1))
    return table(spark, d, "documents").select("doc_id", workflow.analysis_refusal(F.when(n >= 4, n).otherwise(0), F.col("lang").isin("en", "fr"), F.when(F.col("doc_id") % 5 > 3, 1).otherwise(0)).alias("refusal"))


@query("report_review", f"""WITH {_STATUS}, c AS (SELECT finding_id, CASE min(CASE classification WHEN 'UNABLE_TO_EVALUATE' THEN 0 WHEN 'CONFLICT' THEN 1 WHEN 'MISSING' THEN 4 WHEN 'DEVIATION' THEN 5 ELSE 6 END) WHEN 0 THEN 'UNABLE_TO_EVALUATE' WHEN 1 THEN 'CONFLICT' WHEN 4 THEN 'MISSING' WHEN 5 THEN 'DEVIATION' ELSE 'MATCH' END AS classification FROM w GROUP BY finding_id),
i AS (SELECT o_custkey AS review_id, count(*) AS items FROM orders GROUP BY o_custkey),
p AS (SELECT o_custkey AS review_id, count(*) AS evaluated, count(*) FILTER (WHERE classification = 'MATCH') AS matched, count(*) FILTER (WHERE classification = 'DEVIATION') AS deviating, count(*) FILTER (WHERE classification = 'MISSING') AS missing, count(*) FILTER (WHERE classification = 'CONFLICT') AS conflicting, count(*) FILTER (WHERE {TIER1}) AS fail_closed, count(*) FILTER (WHERE requires_decision) AS requiring_decision FROM c JOIN f USING (finding_id) JOIN orders ON o_orderkey = finding_id GROUP BY o_custkey)
SELECT review_id, items, coalesce(evaluated, 0) AS evaluated, coalesce(matched, 0) AS matched, coalesce(deviating, 0) AS deviating, coalesce(missing, 0) AS missing, coalesce(conflicting, 0) AS conflicting, coalesce(fail_closed, 0) AS fail_closed, coalesce(requiring_decision, 0) AS requiring_decision, items - coalesce(evaluated, 0) AS unevaluated, round_even(matched / evaluated::DOUBLE, 4) AS alignment FROM i LEFT JOIN p USING (review_id)""")
def report_review(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("review_id"))
    w = work(spark, d)
    f = rollup.finding_classification(w, ["finding_id"], F.bool_or("requires").alias("requires_decision"))
    items = o.groupBy("review_id").agg(F.count("*").alias("items"))
    return report.review_report(f.join(o, f["finding_id"] == o["o_orderkey"]), items, "review_id")


@query("run_summary", f"WITH e AS ({EVALS}) SELECT finding_id % 50 AS run, count(*) FILTER (WHERE classification IN ('MATCH', 'DEVIATION', 'MISSING')) AS findings_created, count(*) FILTER (WHERE classification = 'CONFLICT') AS skipped_as_optional, count(*) FILTER (WHERE classification = 'UNABLE_TO_EVALUATE') AS failures, string_agg(DISTINCT classification, ',' ORDER BY classification) AS signals FROM e GROUP BY 1")
def run_summary(spark, d):
    e = evaluations(spark, d).select((F.col("finding_id") % 50).alias("run"), F.when(F.col("classification").isin("MATCH", "DEVIATION", "MISSING"), "FINDING").when(F.col("classification") == "CONFLICT", "OPTIONAL").otherwise("FAILURE").alias("outcome"), F.col("classification").alias("signal"))
    return report.run_summary(e, "run")


@query("wait_seconds", "WITH e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, round_even((epoch_us(ts) - epoch_us(before)) / 1000000.0, 3) AS waited FROM e")
def wait_seconds(spark, d):
    from pyspark.sql.window import Window as W

    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", T.wait_seconds(before, F.col("ts")).alias("waited"))


@query("inv_ev_min", "SELECT o_orderkey AS finding_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)")
def inv_ev_min(spark, d):
    e = table(spark, d, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("finding_id"))
    return invariants.without_evaluation(table(spark, d, "orders").select(F.col("o_orderkey").alias("finding_id")), e, "finding_id")


@query("inv_unique", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def inv_unique(spark, d):
    return invariants.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("inv_evidence_cardinality", f"WITH e AS ({EVALS}) SELECT finding_id, evaluation_no, classification FROM e WHERE classification <> 'MISSING' AND actor % 10 = 0")
def inv_evidence_cardinality(spark, d):
    e = evaluations(spark, d).withColumn("evidence", F.when(F.col("actor") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))))
    return invariants.lacking_evidence(e).select("finding_id", "evaluation_no", "classification")


@query("inv_composite_fk", "SELECT o_orderkey AS evaluation_id, o_custkey % 10 + 1 AS finding_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey % 10 + 1)")
def inv_composite_fk(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("finding_id"), F.col("l_orderkey").alias("evaluation_id"))
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("evaluation_id"), (F.col("o_custkey") % 10 + 1).alias("finding_id"))
    return invariants.foreign_decisions(v, e)


@query("inv_closed_sets", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'de') OR lang IS NULL")
def inv_closed_sets(spark, d):
    return invariants.outside(table(spark, d, "documents").select("doc_id", "lang"), "lang", ("en", "de"))


@query("inv_dangling", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def inv_dangling(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'")
    return invariants.dangling(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", o, "o_orderkey").select("l_orderkey", "l_linenumber")


@query("rate_limit_sliding")
def rate_limit_sliding(spark, d):
    """Refused requests do not count, so each depends on those before it: no set expression says this."""
    return rate_limit.limit(table(spark, d, "events"), "user_id", "ts", "event_id", most=3, seconds=86400.0 * 2)
