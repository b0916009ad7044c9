"""Self-checks over the corpus and over inline clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import config_store, extract, mapping, rollup, verify
from lexmill.plans import fixtures
from lexmill.plans.analysis import Requirement, run_analysis
from lexmill.plans.registry import query, table

#: (code, evaluator type, has rules, source, present, scope, preferred, unit, basis) of ratified standards; a source is a
#: clause of the fixtures. Behind each what has to come out, as worked out by hand from the clause.
STANDARDS = (
    ("S01", "NUMERIC_COMPARISON", True, "c01", True, "GENERAL", 12.0, "MONTHS", "FEES_PAID", "PASS", None),
    ("S02", "NUMERIC_COMPARISON", True, "c01", True, "GENERAL", 11.0, "MONTHS", "FEES_PAID", "FAIL", "another position"),
    ("S03", "NUMERIC_COMPARISON", True, "c02", True, "GENERAL", 15.0, "DAYS", "FEES_PAYABLE", "PASS", None),
    ("S04", "NUMERIC_COMPARISON", True, "c02", True, "DATA", 15.0, "DAYS", "FEES_PAYABLE", "FAIL", "no position"),
    ("S05", "NUMERIC_COMPARISON", True, "c03", True, "DATA", 1250000.5, "USD", "FEES_PAID", "PASS", None),
    ("S06", "NUMERIC_COMPARISON", True, "c04", True, "IP", 1.0, "USD", "FEES_PAID", "FAIL", "another position"),
    ("S07", "NUMERIC_COMPARISON", True, "c07", True, "GENERAL", 30.0, "DAYS", None, "FAIL", "mapping not confirmed"),
    ("S08", "NUMERIC_COMPARISON", True, "c09", True, "GENERAL", 24.0, "DAYS", None, "PASS", None),
    ("S09", "PRESENCE", True, "c10", True, None, None, None, None, "PASS", None),
    ("S10", "PRESENCE", True, "c07", True, None, None, None, None, "FAIL", "mapping not confirmed"),
    ("S11", "PRESENCE", False, "c01", True, None, None, None, None, "FAIL", "no rules or source"),
    ("S12", "NUMERIC_COMPARISON", True, None, False, "GENERAL", 1.0, "DAYS", None, "FAIL", "no rules or source"),
    ("S13", "PRESENCE", True, "c99", False, None, None, None, None, "SKIP", "source not present"),
)
_STANDARD = "code string, evaluator_type string, has_rules boolean, source string, source_present boolean, scope_key string, preferred double, unit string, basis string"
_LIABLE = mapping.Rules(code="CAP", confirm_threshold=5, exact_phrases=("liability", "damages", "liable without limit"))


def terms_checked(spark):
    rows = spark.createDataFrame([s[:9] for s in STANDARDS], _STANDARD)
    sources = rows.select("code", "source").join(fixtures.clauses(spark).withColumnRenamed("evidence_id", "source"), "source")
    scored = mapping.score(sources, [_LIABLE], "content", signals=False)
    states = mapping.state(scored.drop("requirement").withColumn("requirement", F.lit("CAP")), ["code"], F.col("source"))
    return verify.terminology(rows, states, extract.extract(sources, ["code"], fixtures.TERMS, clause_id="source"))


_VERDICTS = ", ".join(f"({', '.join(fixtures._quoted(s[i]) for i in (0, 9, 10))})" for s in STANDARDS)


@query("verify_terminology", f"SELECT code, verdict, CAST(reason AS VARCHAR) AS reason FROM (VALUES {_VERDICTS}) t(code, verdict, reason)", ids="O23")
def verify_terminology(spark, d):
    return terms_checked(spark)


@query("verify_tally", f"SELECT count(*) FILTER (WHERE verdict = 'PASS') AS pass, count(*) FILTER (WHERE verdict = 'FAIL') AS fail, count(*) FILTER (WHERE verdict = 'SKIP') AS skip FROM (VALUES {_VERDICTS}) t(code, verdict, reason)", ids="A28")
def verify_tally(spark, d):
    return verify.tally(terms_checked(spark))


@query("record_digest", """WITH e AS (SELECT DISTINCT l_orderkey AS review_id, l_partkey AS code, l_linestatus AS scope, l_returnflag AS c, l_linenumber AS n FROM lineitem),
p AS (SELECT review_id, code, string_agg(scope || '|PRIMARY||' || c || '|NOT_APPLICABLE|' || n, chr(10) ORDER BY scope, c, n) AS lines, max(c) AS top FROM e GROUP BY ALL),
o AS (SELECT review_id, code, sha256(code || '|' || top || '|OPEN' || chr(10) || lines) AS own FROM p)
SELECT review_id, count(*) AS findings, sha256(string_agg(own, ',' ORDER BY code)) AS digest FROM o GROUP BY review_id""", ids="O25")
def record_digest(spark, d):
    c = F.col
    e = table(spark, d, "lineitem").select(c("l_orderkey").alias("review_id"), c("l_partkey").alias("code"), c("l_linestatus").alias("scope_key"), F.lit("PRIMARY").alias("evaluation_kind"), F.lit(None).cast("string").alias("scope_label"), c("l_returnflag").alias("classification"), F.lit("NOT_APPLICABLE").alias("rule_outcome"), c("l_linenumber").alias("evidence_count")).distinct()
    findings = e.groupBy("review_id", "code").agg(F.max("classification").alias("classification"), F.lit("OPEN").alias("status"))
    return verify.record_digest(findings, e)


@query("manifest_check", "SELECT item_id, CASE WHEN doc_id IS NULL THEN 'not listed' WHEN item_id % 2 = 1 THEN 'not specified' ELSE 'covered' END AS verdict FROM (SELECT coalesce(b.item_id, x.doc_id) AS item_id, x.doc_id, b.item_id AS b FROM (SELECT item_id FROM benchmark WHERE item_id % 2 = 0) b FULL OUTER JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 > 0 AND doc_id IN (SELECT item_id FROM benchmark)) x ON x.doc_id = b.item_id)", ids="J19")
def manifest_check(spark, d):
    b = table(spark, d, "benchmark").select("item_id")
    listed = table(spark, d, "documents").filter("doc_id % 3 > 0").select(F.col("doc_id").alias("item_id")).join(b, "item_id", "left_semi")
    return verify.manifest(b.filter("item_id % 2 = 0"), listed, "item_id")


@query("rollup_of_nothing", "SELECT o_orderkey AS review_id, 'no evaluations to roll up' AS failure FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", ids="A8 I1")
def rollup_of_nothing(spark, d):
    findings = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"))
    return rollup.nothing_to_roll_up(findings, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review_id")), ["review_id"])


@query("snapshot_gaps", """SELECT p_partkey AS item, 'company standard' AS part FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 7 NOT IN (SELECT n_nationkey + 1 FROM nation) UNION ALL SELECT p_partkey, 'mapping rules' FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)""", ids="J3 J4")
def snapshot_gaps(spark, d):
    nation = table(spark, d, "nation")
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 7 == 0, F.lit(0)).otherwise(F.lit(1)).alias("standard"), F.col("p_size").alias("mapping"))
    return config_store.missing_parts(items, "item", {"standard": ("company standard", nation.select((F.col("n_nationkey") + 1).alias("id"))), "mapping": ("mapping rules", nation.select(F.col("n_nationkey").alias("id")))})


@query("snapshot_rules", """SELECT o_orderkey AS snapshot_id, p_brand AS code, p_size AS confirm_threshold, p_size % 3 AS phrases FROM orders JOIN part ON p_partkey = o_custkey""", ids="S15 J6")
def snapshot_rules(spark, d):
    c = F.col
    items = table(spark, d, "orders").select(c("o_orderkey").alias("snapshot_id"), c("o_custkey").alias("mapping_rule_version_id"))
    stored = table(spark, d, "part").select(c("p_partkey").alias("mapping_rule_version_id"), c("p_brand").alias("code"), F.to_json(F.struct(c("p_size").alias("confirm_threshold"), F.array_repeat(F.lit("x"), (c("p_size") % 3).cast("int")).alias("exact_phrases"))).alias("rules"))
    rows = config_store.snapshot_rules(items, stored)
    return rows.select("snapshot_id", "code", "rules.confirm_threshold", F.size("rules.exact_phrases").alias("phrases"))


#: Findings of the clauses of the fixtures against a limit of 12 months of fees paid, worked out by hand; clauses without
#: a confirmed mapping leave none.
_FINDINGS = {
    "c01": ("MATCH", False), "c02": ("UNABLE_TO_EVALUATE", True), "c03": ("UNABLE_TO_EVALUATE", True), "c04": ("DEVIATION", True), "c05": ("UNABLE_TO_EVALUATE", True), "c06": ("UNABLE_TO_EVALUATE", True),
    "c09": ("UNABLE_TO_EVALUATE", True), "c10": ("DEVIATION", True), "c11": ("UNABLE_TO_EVALUATE", True), "c12": ("DEVIATION", True),
}
LIMIT = Requirement(rules=_LIABLE, document_type="MSA", preferred=12.0, unit="MONTHS", basis="FEES_PAID", scope_key="GENERAL", terms=fixtures.TERMS, has_rule=True, deviation_outcome="UNACCEPTABLE", unlimited_outcome="UNACCEPTABLE")


@query("analysis_clauses", "SELECT review_id, classification, requires_decision FROM (VALUES " + ", ".join(f"('{k}', '{c}', {str(r).lower()})" for k, (c, r) in _FINDINGS.items()) + ") t(review_id, classification, requires_decision)", ids="O1")
def analysis_clauses(spark, d):
    rows = fixtures.clauses(spark).select(F.col("evidence_id").alias("review_id"), F.lit("MSA").alias("document_type"), "evidence_id", "content", F.lit(None).cast("string").alias("section_title"))
    return run_analysis(rows, [LIMIT])["findings"].select("review_id", "classification", "requires_decision")


def liability_clauses(spark, d):
    """A clause for each line item, in contracts that are orders: so many months as its quantity, or no limit at all."""
    c = F.col
    stated = F.concat(F.lit("Liability shall not exceed "), c("l_quantity").cast("int").cast("string"), F.lit(" months of the fees paid."))
    li = table(spark, d, "lineitem")
    return li.select(c("l_orderkey").alias("review_id"), F.lit("MSA").alias("document_type"), F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"), F.when(c("l_returnflag") == "R", "The supplier accepts unlimited liability.").otherwise(stated).alias("content"), F.lit(None).cast("string").alias("section_title"))


_LIMITS = """c AS (SELECT l_orderkey AS review_id, CASE WHEN l_returnflag = 'R' THEN -1 ELSE CAST(l_quantity AS INTEGER) END AS months FROM lineitem),
g AS (SELECT review_id, count(DISTINCT months) AS n, min(months) AS low, count(*) AS clauses FROM c GROUP BY review_id)"""


@query("analysis_numeric", f"WITH {_LIMITS} SELECT review_id, CASE WHEN n > 1 THEN 'CONFLICT' WHEN low = 12 THEN 'MATCH' ELSE 'DEVIATION' END AS classification, n > 1 OR low <> 12 AS requires_decision FROM g", ids="O1 E2 E9 M9 V6 V9 V11 V16 F9 A4 A5")
def analysis_numeric(spark, d):
    return run_analysis(liability_clauses(spark, d), [LIMIT])["findings"].select("review_id", "classification", "requires_decision")


@query("analysis_evaluations", f"WITH {_LIMITS} SELECT review_id, 'PRIMARY' AS evaluation_kind, 'GENERAL' AS scope_key, CASE WHEN n > 1 OR low = 12 THEN 'NOT_APPLICABLE' ELSE 'UNACCEPTABLE' END AS rule_outcome, 'CONFIRMED' AS mapping_state, CASE WHEN n > 1 THEN 'CONFLICTING' ELSE 'PRIMARY' END AS relation, 'numeric-1' AS evaluator_version FROM g", ids="V1 V16 Z26")
def analysis_evaluations(spark, d):
    return run_analysis(liability_clauses(spark, d), [LIMIT])["evaluations"].select("review_id", "evaluation_kind", "scope_key", "rule_outcome", "mapping_state", "relation", "evaluator_version")
