"""Extraction and evaluation: over inline cases, and over line items as caps for scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import evaluate, extract, report, rollup
from lexmill.plans import analysis, fixtures
from lexmill.plans.q_mapping import LINES, score_sql
from lexmill.plans.q_text import WS, contains_sql
from lexmill.plans.registry import query, table

TERMS = fixtures.TERMS
_CLAUSES = fixtures.values(list(fixtures.CLAUSES), "evidence_id string, content string", "c") + f", b AS (SELECT evidence_id, lower(trim(regexp_replace(content, '{WS}+', ' ', 'g'))) AS body FROM c)"


def _any(phrases) -> str:
    return "(" + " OR ".join(contains_sql("body", p) for p in phrases) + ")"


_UNITS = "|".join(TERMS.unit_terms())
_NUMBER = rf"(?:^|[^\p{{L}}\p{{N}}_])(\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?|\d+(?:\.\d+)?)\s*(?:\)|\([a-z]+\))?\s*({_UNITS})(?:$|[^\p{{L}}\p{{N}}_])"
_UNIT_NAME = "CASE regexp_extract(body, p, 2) " + " ".join(f"WHEN '{t}' THEN '{u}'" for t, u in TERMS.unit_terms().items()) + " END"
_BASIS = "CASE " + " ".join(f"WHEN {_any(TERMS.bases[b])} THEN '{b}'" for b in sorted(TERMS.bases)) + " END"
_READ = f"""{_CLAUSES}, m AS (SELECT evidence_id, body, '{_NUMBER}' AS p, {_any(TERMS.unlimited_phrases)} AS unlimited, {_any(TERMS.cap_phrases)} AS capped, {_any(TERMS.composite_phrases)} AS composite, {_BASIS} AS basis FROM b),
f AS (SELECT *, CASE WHEN regexp_matches(body, p) THEN CAST(replace(regexp_extract(body, p, 1), ',', '') AS DOUBLE) END AS value, CASE WHEN regexp_matches(body, p) THEN {_UNIT_NAME} END AS unit FROM m),
s AS (SELECT *, CASE WHEN unlimited THEN 'UNLIMITED' WHEN composite THEN 'UNKNOWN' WHEN value IS NOT NULL THEN 'FINITE' ELSE 'UNKNOWN' END AS status FROM f),
e AS (""" + " UNION ALL ".join(f"SELECT evidence_id, '{scope}' AS scope, {fixtures._quoted(label)} AS scope_label FROM b WHERE {_any(terms)}" for scope, label, terms in TERMS.exceptions) + """),
caps AS (SELECT s.evidence_id, CASE WHEN e.scope IS NULL THEN 'PRIMARY' ELSE 'EXCEPTION' END AS kind, coalesce(e.scope, 'GENERAL') AS scope, e.scope_label, status, CASE WHEN status = 'FINITE' THEN value END AS value, CASE WHEN status = 'FINITE' THEN unit END AS unit, basis
FROM s LEFT JOIN e USING (evidence_id) WHERE unlimited OR capped)"""


def _bodies(spark):
    from lexmill.functions.text import normalize

    return fixtures.clauses(spark).select("evidence_id", normalize(F.col("content")).alias("body"))


@query("extract_magnitude", f"WITH {_READ} SELECT evidence_id, value FROM f")
def extract_magnitude(spark, d):
    return _bodies(spark).select("evidence_id", extract.magnitude(F.col("body"), TERMS)["value"].alias("value"))


@query("extract_units_canonical", f"WITH {_READ} SELECT evidence_id, unit FROM f WHERE unit IS NOT NULL")
def extract_units_canonical(spark, d):
    return _bodies(spark).select("evidence_id", extract.magnitude(F.col("body"), TERMS)["unit"].alias("unit")).filter("unit is not null")


@query("extract_basis", f"WITH {_READ} SELECT evidence_id, basis FROM f")
def extract_basis(spark, d):
    return _bodies(spark).select("evidence_id", extract.basis(F.col("body"), TERMS).alias("basis"))


@query("extract_status", f"WITH {_READ} SELECT DISTINCT evidence_id, status FROM caps")
def extract_status(spark, d):
    return extract.extract(fixtures.clauses(spark), [], TERMS).select("evidence_id", "status").distinct()


@query("extract_carveouts", f"WITH {_READ} SELECT * FROM caps")
def extract_carveouts(spark, d):
    return extract.extract(fixtures.clauses(spark), [], TERMS)


@query("extract_fact_status", f"""WITH {_READ}, g AS (SELECT evidence_id, unnest([substr(evidence_id, 2, 1), CASE WHEN body = '' THEN 'blank' ELSE 'text' END, CASE WHEN evidence_id IN ('c07', 'c08') THEN 'none' ELSE 'all' END]) AS grp, body FROM b),
n AS (SELECT grp, count(*) AS clauses, count(*) FILTER (WHERE body = '') AS blank, CAST(coalesce(sum(k), 0) AS BIGINT) AS caps FROM g LEFT JOIN (SELECT evidence_id, count(*) AS k FROM caps GROUP BY evidence_id) USING (evidence_id) GROUP BY grp)
SELECT grp, clauses, blank, caps, CASE WHEN caps = 0 AND blank = clauses THEN 'FAILED' WHEN caps = 0 THEN 'COMPLETE' WHEN blank > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM n""")
def extract_fact_status(spark, d):
    c = fixtures.clauses(spark)
    names = F.array(F.substring("evidence_id", 2, 1), F.when(F.col("content").rlike(r"\S"), "text").otherwise("blank"), F.when(F.col("evidence_id").isin("c07", "c08"), "none").otherwise("all"))
    return extract.fact_status(c.withColumn("grp", F.explode(names)), ["grp"], TERMS)


OUT = "CASE WHEN {0} IN ('ACCEPTABLE', 'APPROVAL_REQUIRED', 'UNACCEPTABLE', 'NOT_APPLICABLE') THEN {0} ELSE 'NOT_APPLICABLE' END"
_NUMERIC = f"""{fixtures.values(fixtures.numeric_rows()[0], fixtures.SUBJECT, 'subject')}, {fixtures.values(fixtures.numeric_rows()[1], fixtures.CAPS, 'cap')},
merged AS (SELECT "case_id", kind, scope, coalesce(scope_label, '') AS label, max(scope_label) AS scope_label, count(DISTINCT (status, coalesce(value, -1e300), coalesce(unit, chr(1)), coalesce(basis, chr(1)))) AS positions, min(status) AS status, min(value) AS value, min(unit) AS unit, min(basis) AS basis, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence FROM cap GROUP BY ALL),
judged AS (SELECT m.*, s.*, coalesce(scope = std_scope OR (std_scope IS NOT NULL AND list_contains(coalesce(comparable_scopes, []), scope)), false) AS scope_ok, coalesce(basis = std_basis OR (std_basis IS NOT NULL AND list_contains(coalesce(comparable_bases, []), basis)), false) AS basis_ok
FROM merged m JOIN subject s USING ("case_id") WHERE s.facts_status <> 'FAILED'),
rung AS (SELECT *, CASE WHEN positions > 1 THEN 0 WHEN scope = 'UNKNOWN' AND coalesce(scope_required, true) THEN 1 WHEN status = 'UNKNOWN' THEN 2 WHEN status = 'UNLIMITED' THEN 3 WHEN status = 'ABSENT' THEN 4 WHEN value IS NULL OR unit IS NULL THEN 5 WHEN NOT scope_ok THEN 6 WHEN unit IS DISTINCT FROM std_unit THEN 7 WHEN NOT basis_ok THEN 8 WHEN preferred IS NULL THEN 9 WHEN value = preferred THEN 10 ELSE 11 END AS r FROM judged),
result AS (SELECT "case_id", kind AS evaluation_kind, scope AS scope_key, scope_label, evidence, CASE WHEN r = 0 THEN 'CONFLICT' WHEN r IN (3, 11) THEN 'DEVIATION' WHEN r = 4 THEN 'MISSING' WHEN r = 10 THEN 'MATCH' ELSE 'UNABLE_TO_EVALUATE' END AS classification,
CASE WHEN r = 3 AND has_rule THEN {OUT.format('unlimited_outcome')} WHEN r <> 11 OR NOT has_rule THEN 'NOT_APPLICABLE' WHEN deviation_outcome IS NOT NULL THEN {OUT.format('deviation_outcome')} WHEN value > approval_required_above THEN 'APPROVAL_REQUIRED' WHEN value <= acceptable_max THEN 'ACCEPTABLE' WHEN value > acceptable_max THEN 'APPROVAL_REQUIRED' ELSE 'NOT_APPLICABLE' END AS rule_outcome FROM rung
UNION ALL SELECT "case_id", 'PRIMARY', coalesce(nullif(std_scope, ''), 'UNKNOWN'), NULL, 'm1,m2', 'UNABLE_TO_EVALUATE', 'NOT_APPLICABLE' FROM subject WHERE coalesce(facts_status, 'FAILED') = 'FAILED'
UNION ALL SELECT "case_id", 'PRIMARY', coalesce(nullif(std_scope, ''), 'UNKNOWN'), NULL, '', 'MISSING', 'NOT_APPLICABLE' FROM subject s WHERE facts_status <> 'FAILED' AND NOT EXISTS (FROM cap c WHERE c."case_id" = s."case_id"))"""


def numeric_results(spark):
    subjects, caps = fixtures.numeric(spark)
    return evaluate.evaluate_numeric(subjects, caps, ["case_id"]).withColumn("evidence", F.array_join("evidence", ","))


def _cases(name: str, cases: tuple[str, ...] | None = None) -> None:
    where = f" WHERE \"case_id\" IN ({', '.join(repr(c) for c in cases)})" if cases else ""

    @query(name, f'WITH {_NUMERIC} SELECT "case_id", evaluation_kind, scope_key, scope_label, classification, rule_outcome, evidence FROM result{where}')
    def run(spark, d):
        rows = numeric_results(spark).select("case_id", "evaluation_kind", "scope_key", "scope_label", "classification", "rule_outcome", "evidence")
        return rows.filter(F.col("case_id").isin(*cases)) if cases else rows


_cases("eval_numeric_ladder")
_cases("eval_rule_outcome", ("N08", "N09", "N10", "N11", "N12", "N13", "N14"))
_cases("eval_unlimited", ("N04", "N15", "N26"))
_cases("eval_same_scope_merge", ("N03", "N23", "N26", "N27"))
_cases("eval_absent", ("N02", "N16", "N21", "N22"))

#: Line items as caps of an order: scope by return flag, exceptions where shipped, position by quantity and tax.
_LINE_CAPS = "l_orderkey AS case_id, CASE WHEN l_linestatus = 'F' THEN 'EXCEPTION' ELSE 'PRIMARY' END AS kind, l_returnflag AS scope, CAST(NULL AS {0}) AS scope_label, CASE WHEN l_tax > 0.07 THEN 'UNLIMITED' WHEN l_discount > 0.09 THEN 'UNKNOWN' ELSE 'FINITE' END AS status, CASE WHEN l_quantity <= 25 THEN 10.0 ELSE l_quantity END AS value, CASE WHEN l_tax > 0.06 THEN 'UNIT_Y' ELSE 'UNIT_X' END AS unit, CASE WHEN l_discount < 0.01 THEN 'Q' ELSE 'P' END AS basis, CAST(l_linenumber AS {0}) AS evidence_id"


@query("eval_scope_conflict", f"""
WITH c AS (SELECT {_LINE_CAPS.format('VARCHAR')} FROM lineitem), g AS (SELECT case_id, kind, scope, count(DISTINCT (status, value, unit, basis)) AS positions, count(DISTINCT evidence_id) AS evidence, min(status) AS status, min(value) AS value, min(unit) AS unit, min(basis) AS basis FROM c GROUP BY case_id, kind, scope)
SELECT case_id, kind AS evaluation_kind, scope AS scope_key, CAST(evidence AS INTEGER) AS evidence,
CASE WHEN positions > 1 THEN 'CONFLICT' WHEN status = 'UNKNOWN' THEN 'UNABLE_TO_EVALUATE' WHEN status = 'UNLIMITED' THEN 'DEVIATION' WHEN scope NOT IN ('R', 'N') OR unit <> 'UNIT_X' OR basis <> 'P' THEN 'UNABLE_TO_EVALUATE' WHEN value = 10 THEN 'MATCH' ELSE 'DEVIATION' END AS classification,
CASE WHEN positions > 1 OR status = 'UNKNOWN' THEN 'NOT_APPLICABLE' WHEN status = 'UNLIMITED' THEN 'UNACCEPTABLE' WHEN scope NOT IN ('R', 'N') OR unit <> 'UNIT_X' OR basis <> 'P' OR value = 10 THEN 'NOT_APPLICABLE' WHEN value > 45 THEN 'APPROVAL_REQUIRED' WHEN value <= 30 THEN 'ACCEPTABLE' ELSE 'APPROVAL_REQUIRED' END AS rule_outcome FROM g
""")
def eval_scope_conflict(spark, d):
    caps = table(spark, d, "lineitem").selectExpr(*_split(_LINE_CAPS.format("string")))
    standard = dict(std_scope="R", std_unit="UNIT_X", std_basis="P", preferred=10.0, has_rule=True, scope_required=True, comparable_scopes=["N"], comparable_bases=None, deviation_outcome=None, unlimited_outcome="UNACCEPTABLE", approval_required_above=45.0, acceptable_max=30.0)
    kinds = {"comparable_scopes": "array<string>", "comparable_bases": "array<string>", "deviation_outcome": "string"}
    merged = evaluate.same_scope(caps, ["case_id"])
    # One standard for all: its values are literals, and nothing is joined.
    for name, v in standard.items():
        lit = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        merged = merged.withColumn(name, lit.cast(kinds[name]) if name in kinds else lit)
    r = F.when(F.col("positions") > 1, F.struct(F.lit("CONFLICT").alias("classification"), F.lit("NOT_APPLICABLE").alias("rule_outcome"))).otherwise(evaluate.ladder())
    rows = merged.withColumn("r", r)
    return rows.select("case_id", F.col("kind").alias("evaluation_kind"), F.col("scope").alias("scope_key"), F.size("evidence").alias("evidence"), "r.classification", "r.rule_outcome")


def _split(columns: str) -> list[str]:
    """A select list at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


_PRESENCE = fixtures.values([(c, s, e, q, h, o, None, ["m1", "m2"]) for c, s, e, q, h, o, _ in fixtures.PRESENCE_CASES], fixtures.PRESENCE, "p")


@query("eval_presence", f"""WITH {_PRESENCE} SELECT "case_id", 'DEFAULT' AS scope_key,
CASE WHEN mapping_state = 'CONFIRMED' THEN CASE expected_presence WHEN 'PRESENT' THEN 'MATCH' ELSE 'DEVIATION' END WHEN mapping_state = 'NONE' THEN CASE expected_presence WHEN 'ABSENT' THEN 'MATCH' ELSE 'MISSING' END ELSE 'UNABLE_TO_EVALUATE' END AS classification,
CASE WHEN has_rule AND (mapping_state, expected_presence) IN (('CONFIRMED', 'PRESENT'), ('NONE', 'ABSENT')) THEN 'ACCEPTABLE' WHEN has_rule AND mapping_state = 'CONFIRMED' THEN {OUT.format('deviation_outcome')} ELSE 'NOT_APPLICABLE' END AS rule_outcome,
CASE WHEN mapping_state = 'NONE' THEN '' ELSE 'm1,m2' END AS evidence FROM p WHERE expected_presence IS NOT NULL AND mapping_state IS NOT NULL AND NOT (mapping_state = 'NONE' AND expected_presence <> 'ABSENT' AND NOT required)""")
def eval_presence(spark, d):
    rows = evaluate.evaluate_presence(fixtures.presence(spark), ["case_id"])
    return rows.select("case_id", "scope_key", "classification", "rule_outcome", F.array_join("evidence", ",").alias("evidence"))


@query("eval_optional_suppressed", f"""WITH {LINES}, s AS (SELECT doc_id, max({score_sql(fixtures.CORPUS_RULES[0])}) AS best, count(*) FILTER (WHERE {score_sql(fixtures.CORPUS_RULES[0])} > 0) AS positive FROM body GROUP BY doc_id)
SELECT doc_id, CASE WHEN best >= 5 THEN 'MATCH' ELSE 'UNABLE_TO_EVALUATE' END AS classification FROM s WHERE positive > 0""")
def eval_optional_suppressed(spark, d):
    from lexmill.plans.q_mapping import scored

    from lexmill.operators import mapping

    st = mapping.state(scored(spark, d, fixtures.CORPUS_RULES[:1]), ["doc_id"], F.col("line_no"))
    subject = st.select("doc_id", F.col("state").alias("mapping_state"), F.lit("PRESENT").alias("expected_presence"), F.lit(False).alias("required"), F.lit(True).alias("has_rule"), F.lit(None).cast("string").alias("deviation_outcome"), F.lit(None).cast("string").alias("std_scope"), F.col("evidence").alias("candidates"))
    return evaluate.evaluate_presence(subject, ["doc_id"]).select("doc_id", "classification")


@query("eval_misconfigured", f"WITH {_PRESENCE} SELECT \"case_id\", CASE WHEN expected_presence IS NULL THEN 'no expected_presence' ELSE 'no mapping' END AS failure FROM p WHERE expected_presence IS NULL OR mapping_state IS NULL")
def eval_misconfigured(spark, d):
    return evaluate.misconfigured(fixtures.presence(spark)).select("case_id", "failure")


@query("eval_applicability", "SELECT lang, lang <> 'OPTIONAL' AS required, CASE WHEN lang IN ('REQUIRED', 'OPTIONAL') THEN NULL ELSE 'applicability not declared' END AS diagnostic, count(*) AS n FROM (SELECT CASE lang WHEN 'en' THEN 'REQUIRED' WHEN 'fr' THEN 'OPTIONAL' ELSE lang END AS lang FROM documents) GROUP BY lang")
def eval_applicability(spark, d):
    lang = F.when(F.col("lang") == "en", "REQUIRED").when(F.col("lang") == "fr", "OPTIONAL").otherwise(F.col("lang"))
    rows = table(spark, d, "documents").select(lang.alias("lang"), evaluate.applicability(lang).alias("a"))
    return rows.groupBy("lang", F.col("a.required").alias("required"), F.col("a.diagnostic").alias("diagnostic")).agg(F.count("*").alias("n"))


#: Line items as evaluations of an order.
EVALS = "SELECT l_orderkey AS finding_id, l_linenumber AS evaluation_no, l_suppkey AS actor, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'CONFLICT' WHEN l_returnflag = 'R' THEN 'DEVIATION' WHEN l_returnflag = 'A' AND l_quantity < 5 THEN 'UNABLE_TO_EVALUATE' WHEN l_returnflag = 'A' THEN 'MISSING' ELSE 'MATCH' END AS classification, CASE WHEN l_linestatus = 'O' AND l_tax > 0.06 THEN 'UNACCEPTABLE' WHEN l_tax > 0.04 THEN 'APPROVAL_REQUIRED' WHEN l_tax > 0.02 THEN 'ACCEPTABLE' ELSE 'NOT_APPLICABLE' END AS rule_outcome, l_discount < 0.05 AS required FROM lineitem"
RANKED = "CASE classification WHEN 'UNABLE_TO_EVALUATE' THEN 0 WHEN 'CONFLICT' THEN 1 WHEN 'AMBIGUOUS' THEN 2 WHEN 'UNRESOLVED' THEN 3 WHEN 'MISSING' THEN 4 WHEN 'DEVIATION' THEN 5 ELSE 6 END"
TIER1 = "classification IN ('UNABLE_TO_EVALUATE', 'CONFLICT', 'AMBIGUOUS', 'UNRESOLVED')"


def evaluations(spark, d):
    return table(spark, d, "lineitem").selectExpr(*_split(EVALS.removeprefix("SELECT ").removesuffix(" FROM lineitem")))


@query("rollup_finding", f"WITH e AS ({EVALS}) SELECT finding_id, arg_min(classification, {RANKED}) AS classification, count(*) AS evaluations FROM e GROUP BY finding_id")
def rollup_finding(spark, d):
    return rollup.finding_classification(evaluations(spark, d), ["finding_id"])


@query("rollup_tier", f"WITH e AS ({EVALS}), f AS (SELECT finding_id, min({RANKED}) AS r FROM e GROUP BY finding_id) SELECT CAST(CASE WHEN r < 4 THEN 1 ELSE 2 END AS INTEGER) AS tier, count(*) AS findings FROM f GROUP BY 1")
def rollup_tier(spark, d):
    f = rollup.finding_classification(evaluations(spark, d), ["finding_id"])
    return f.groupBy(rollup.tier(F.col("classification")).cast("int").alias("tier")).agg(F.count("*").alias("findings"))


@query("fail_closed_rate", f"WITH e AS ({EVALS}) SELECT round_even(count(*) FILTER (WHERE {TIER1}) / count(*)::DOUBLE, 4) AS fail_closed_rate, count(*) AS total FROM e")
def fail_closed_rate(spark, d):
    return rollup.fail_closed_rate(evaluations(spark, d))


@query("classification_histogram", f"WITH e AS ({EVALS}) SELECT classification, CASE WHEN {TIER1} THEN 'analysis.fail_closed_rate' ELSE 'analysis.classification_count' END AS signal, count(*) AS n FROM e GROUP BY classification")
def classification_histogram(spark, d):
    return rollup.histogram(evaluations(spark, d), "classification").withColumn("signal", rollup.signal_name(F.col("classification")))


_EXPECTED = fixtures.values([(c, k, s, lab, x, o) for c, *_, exp in fixtures.NUMERIC_CASES for k, s, lab, x, o in exp], "case_id string, evaluation_kind string, scope_key string, scope_label string, classification string, rule_outcome string", "expected")


@query("corpus_expected_vs_actual", f"""WITH {_NUMERIC}, {_EXPECTED} SELECT coalesce(e."case_id", r."case_id") AS "case_id", coalesce(e.evaluation_kind, r.evaluation_kind) AS evaluation_kind, coalesce(e.scope_key, r.scope_key) AS scope_key, coalesce(e.scope_label, r.scope_label) AS scope_label,
CASE WHEN e."case_id" IS NULL THEN 'unexpected' WHEN r."case_id" IS NULL THEN 'absent' WHEN (e.classification, e.rule_outcome) = (r.classification, r.rule_outcome) THEN 'same' ELSE 'changed' END AS verdict
FROM expected e FULL OUTER JOIN result r ON e."case_id" = r."case_id" AND e.evaluation_kind = r.evaluation_kind AND e.scope_key = r.scope_key AND coalesce(e.scope_label, '') = coalesce(r.scope_label, '')""")
def corpus_expected_vs_actual(spark, d):
    rows = [(c, k, s, lab, x, o) for c, *_, exp in fixtures.NUMERIC_CASES for k, s, lab, x, o in exp]
    want = spark.createDataFrame(rows, "case_id string, evaluation_kind string, scope_key string, scope_label string, classification string, rule_outcome string")
    return report.difference(want, numeric_results(spark), ["case_id", "evaluation_kind", "scope_key", "scope_label"], ["classification", "rule_outcome"])


def corpus_clauses(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), F.col("lang").alias("document_type"), F.substring_index("text", "\n", 1).alias("section_title"), F.posexplode(F.split("text", "\n", -1)).alias("evidence_id", "content"))
    return docs.withColumn("evidence_id", F.col("evidence_id").cast("string"))




@query("analysis_findings", f"WITH {LINES}, d AS (SELECT doc_id, lang FROM documents), s AS (" + " UNION ALL ".join(
    f"SELECT b.doc_id, '{r.code}' AS requirement, max({score_sql(r.rules)}) >= {r.rules.confirm_threshold} AS confirmed, count(*) FILTER (WHERE {score_sql(r.rules)} > 0) > 0 AS positive, {str(r.has_rule).lower()} AS has_rule, '{r.expected_presence}' AS expected, {str(r.required).lower()} AS required, {fixtures._quoted(r.deviation_outcome)} AS outcome FROM body b JOIN d ON d.doc_id = b.doc_id AND d.lang = '{r.document_type}' GROUP BY b.doc_id" for r in fixtures.SNAPSHOT
) + """), c AS (SELECT *, CASE WHEN confirmed THEN CASE expected WHEN 'PRESENT' THEN 'MATCH' ELSE 'DEVIATION' END WHEN positive THEN 'UNABLE_TO_EVALUATE' WHEN expected = 'ABSENT' THEN 'MATCH' WHEN required THEN 'MISSING' END AS classification FROM s),
o AS (SELECT *, CASE WHEN has_rule AND classification = 'MATCH' THEN 'ACCEPTABLE' WHEN has_rule AND classification = 'DEVIATION' THEN coalesce(outcome, 'NOT_APPLICABLE') ELSE 'NOT_APPLICABLE' END AS rule_outcome FROM c WHERE classification IS NOT NULL)
SELECT doc_id AS review_id, requirement, classification, rule_outcome IN ('APPROVAL_REQUIRED', 'UNACCEPTABLE') OR classification = 'UNABLE_TO_EVALUATE' OR (classification = 'MISSING' AND required) OR (classification = 'DEVIATION' AND rule_outcome = 'NOT_APPLICABLE') AS requires_decision FROM o""")
def analysis_findings(spark, d):
    return analysis.run_analysis(corpus_clauses(spark, d), fixtures.SNAPSHOT)["findings"].select("review_id", "requirement", "classification", "requires_decision")
