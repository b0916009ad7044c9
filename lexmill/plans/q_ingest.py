"""Ingest and dispatch: customers stand for contracts, orders for document versions and reviews, line items for segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import admin, ingest, invariants, report, rollup
from lexmill.operators.evaluate import same_scope
from lexmill.plans.registry import query, table
from lexmill.sources import sinks
from lexmill.sources import uploads as uploads_of

#: Finished orders are stored versions, the others uploads; the priority stands for the bytes.
_STORED = """stored AS (SELECT o_custkey AS contract_id, o_orderpriority AS file_hash, o_orderkey AS version_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version_number
  FROM orders WHERE o_orderstatus = 'F'),
up AS (SELECT o_custkey AS contract_id, o_orderpriority AS file_hash, o_orderkey AS upload_id FROM orders WHERE o_orderstatus <> 'F')"""
_PARSED = "parsed AS (SELECT l_orderkey AS version_id, count(*) AS segments, CASE WHEN max(l_quantity) < 25 THEN 'FAILED' ELSE 'COMPLETE' END AS extraction_status FROM lineitem GROUP BY l_orderkey)"


def stored(spark, d):
    from pyspark.sql.window import Window as W

    rows = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return rows.select(F.col("o_custkey").alias("contract_id"), F.col("o_orderpriority").alias("file_hash"), F.col("o_orderkey").alias("version_id"), n.alias("version_number"))


def uploads(spark, d):
    rows = table(spark, d, "orders").filter("o_orderstatus <> 'F'")
    return rows.select(F.col("o_custkey").alias("contract_id"), F.col("o_orderpriority").alias("file_hash"), F.col("o_orderkey").alias("upload_id"))


def parsed(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("version_id"))
    return per.agg(F.count("*").alias("segments"), F.when(F.max("l_quantity") < 25, "FAILED").otherwise("COMPLETE").alias("extraction_status"))


@query("ingest_versions", f"""WITH {_STORED}, top AS (SELECT contract_id, max(version_number) AS top FROM stored GROUP BY contract_id),
n AS (SELECT up.*, coalesce(top, 0) + row_number() OVER (PARTITION BY contract_id ORDER BY upload_id) AS version_number FROM up LEFT JOIN top USING (contract_id)),
every AS (SELECT contract_id, file_hash, version_number, version_id FROM stored UNION ALL SELECT contract_id, file_hash, version_number, upload_id FROM n),
first AS (SELECT contract_id, file_hash, min(version_number) AS first_number, arg_min(version_id, version_number) AS first_id FROM every GROUP BY contract_id, file_hash)
SELECT n.upload_id AS version_id, contract_id, n.version_number, CAST(CASE WHEN first_number < n.version_number THEN first_id END AS VARCHAR) AS duplicate_of FROM n JOIN first USING (contract_id, file_hash)""",
       ids="K2 H12 J16 W7 A13")
def ingest_versions(spark, d):
    rows = ingest.new_versions(uploads(spark, d), stored(spark, d))
    return rows.select(F.col("upload_id").alias("version_id"), "contract_id", "version_number", F.col("duplicate_of").cast("string").alias("duplicate_of"))


_RUNS = f"""{_PARSED}, runs AS (SELECT o_orderkey AS version_id, coalesce(extraction_status = 'FAILED', true) AS failed, segments FROM orders LEFT JOIN parsed ON version_id = o_orderkey)"""


def runs(spark, d):
    return ingest.processing_runs(table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id")), parsed(spark, d))


@query("ingest_runs", f"""WITH {_RUNS} SELECT version_id, CAST(1 AS BIGINT) AS attempt, version_id || ':1' AS run_id, 'PARSE' AS run_type, CASE WHEN failed THEN 'FAILED' ELSE 'COMPLETED' END AS status,
CASE WHEN failed THEN 'EXTRACTION_FAILED' END AS error_code, CASE WHEN failed THEN 0 ELSE segments END AS evidence_count FROM runs""", ids="K2 A23 S2")
def ingest_runs(spark, d):
    return runs(spark, d)


@query("ingest_retry", f"""WITH {_RUNS}, again AS (SELECT version_id, version_id % 2 = 0 AS failed, segments FROM runs WHERE failed)
SELECT version_id, CAST(2 AS BIGINT) AS attempt, version_id || ':2' AS run_id, 'REPROCESS' AS run_type, CASE WHEN failed OR segments IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status,
CASE WHEN failed OR segments IS NULL THEN 'EXTRACTION_FAILED' END AS error_code, CASE WHEN failed THEN 0 ELSE coalesce(segments, 0) END AS evidence_count FROM again""", ids="O14")
def ingest_retry(spark, d):
    """What could not be read is tried again; the second time all versions of odd numbers can be."""
    first = runs(spark, d)
    better = parsed(spark, d).withColumn("extraction_status", F.when(F.col("version_id") % 2 == 0, "FAILED").otherwise("COMPLETE"))
    return ingest.processing_runs(ingest.to_retry(first), better, first, "REPROCESS")


@query("ingest_evidence", f"""WITH {_RUNS}, seg AS (SELECT l_orderkey AS version_id, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS evidence_id, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber % 3 END AS page_number, l_partkey AS start_offset FROM lineitem)
SELECT version_id || ':1' AS run_id, evidence_id, row_number() OVER (PARTITION BY version_id ORDER BY page_number NULLS LAST, start_offset, evidence_id) AS place FROM seg JOIN runs USING (version_id) WHERE NOT failed""", ids="K2 T4")
def ingest_evidence(spark, d):
    li = table(spark, d, "lineitem")
    seg = li.select(F.col("l_orderkey").alias("version_id"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"), F.expr("if(l_linenumber % 3 > 0, l_linenumber % 3, null)").alias("page_number"), F.col("l_partkey").alias("start_offset"))
    return ingest.evidence_rows(seg, runs(spark, d)).select("run_id", "evidence_id", "place")


#: Orders as reviews, urgent ones closed; a line item that came back is a finding.
_MAY = """may AS (SELECT o_orderkey AS review_id, o_custkey AS created_by, count(l_orderkey) AS findings, CASE WHEN count(l_orderkey) > 0 THEN 'already analysed' WHEN o_orderpriority LIKE '1%' THEN 'closed to analysis' END AS refusal
FROM orders LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority)"""


def may_analyse(spark, d):
    status = F.when(F.col("o_orderpriority").like("1%"), "CLOSED").otherwise("UPLOADED")
    reviews = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("created_by"), status.alias("status"))
    findings = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("review_id"))
    return ingest.may_analyse(reviews, findings)


@query("analysis_may_start", f"WITH {_MAY} SELECT review_id, findings, refusal FROM may", ids="O4 A15")
def analysis_may_start(spark, d):
    return may_analyse(spark, d).select("review_id", "findings", "refusal")


@query("job_queue", f"WITH {_MAY} SELECT review_id, created_by AS actor_id, 'v1' AS fingerprint FROM may WHERE refusal IS NULL", ids="K10 R1")
def job_queue(spark, d):
    return ingest.queue_jobs(may_analyse(spark, d), F.lit("v1"))


@query("job_retries", "SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 60 WHEN 'click' THEN 10 END AS VARCHAR) AS delay FROM events", ids="R3")
def job_retries(spark, d):
    outcome = F.when(F.col("event_type") == "view", "SKEW").when(F.col("event_type") == "click", "ERROR").otherwise("REFUSED")
    return table(spark, d, "events").select("event_id", ingest.retry_delay(outcome).cast("string").alias("delay"))


@query("review_open", """WITH o AS (SELECT o_orderkey AS id, o_custkey % 40 AS version_id, o_custkey % 3 AS snapshot_id, o_orderpriority AS created_by, o_orderdate AS created_at, o_orderstatus = 'F' AS is_stored FROM orders),
old AS (SELECT version_id, snapshot_id, created_by, id AS old_id FROM (SELECT *, row_number() OVER (PARTITION BY version_id, snapshot_id, created_by ORDER BY created_at, id) AS k FROM o WHERE is_stored) WHERE k = 1),
first AS (SELECT version_id, snapshot_id, created_by, min(id) AS first_id FROM o WHERE NOT is_stored GROUP BY ALL)
SELECT o.id AS request_id, coalesce(old_id, first_id) AS review_id, old_id IS NULL AND o.id = first_id AS created FROM o JOIN first USING (version_id, snapshot_id, created_by) LEFT JOIN old USING (version_id, snapshot_id, created_by) WHERE NOT is_stored""",
       ids="H13 J17 W8")
def review_open(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("version_id"), (F.col("o_custkey") % 3).alias("snapshot_id"), F.col("o_orderpriority").alias("created_by"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    requests = o.filter("o_orderstatus <> 'F'").withColumnRenamed("id", "request_id")
    return ingest.open_reviews(requests, o.filter("o_orderstatus = 'F'").withColumnRenamed("id", "review_id")).select("request_id", "review_id", "created")


@query("publish_rows", """WITH e AS (SELECT l_orderkey AS review_id, l_partkey AS requirement, CASE l_returnflag WHEN 'R' THEN 'DEVIATION' WHEN 'A' THEN 'MISSING' ELSE 'MATCH' END AS classification, CASE WHEN l_linenumber % 5 > 0 THEN 1 ELSE 0 END AS evidence FROM lineitem),
bad AS (SELECT review_id, requirement, bool_or(evidence = 0 AND classification <> 'MISSING') AS bad FROM e GROUP BY ALL)
SELECT review_id, requirement, CASE WHEN bad THEN 'evidence' WHEN review_id % 4 = 0 THEN 'stored' ELSE 'new' END AS outcome FROM bad""", ids="I4 J15")
def publish_rows(spark, d):
    """What a publishing step does with each finding: a fourth of the reviews are stored already."""
    kind = F.when(F.col("l_returnflag") == "R", "DEVIATION").when(F.col("l_returnflag") == "A", "MISSING").otherwise("MATCH")
    evidence = F.when(F.col("l_linenumber") % 5 > 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review_id"), F.col("l_partkey").alias("requirement"), kind.alias("classification"), evidence.alias("evidence"))
    keys = ["review_id", "requirement"]
    bad = invariants.lacking_evidence(e).select(*keys).distinct().withColumn("bad", F.lit(True))
    rows = e.select(*keys).distinct().join(bad, keys, "left")
    old = rows.filter("review_id % 4 = 0").select(*keys, F.lit(True).alias("old"))
    return rows.join(old, keys, "left").select(*keys, F.when(F.col("bad"), "evidence").when(F.col("old"), "stored").otherwise("new").alias("outcome"))


@query("eval_evidence_order", """WITH c AS (SELECT l_orderkey AS review_id, l_returnflag AS scope, l_quantity AS q, l_partkey AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seen FROM lineitem),
f AS (SELECT review_id, scope, e, min(seen) AS seen FROM c GROUP BY ALL)
SELECT review_id, scope, string_agg(CAST(e AS VARCHAR), ',' ORDER BY seen) AS evidence FROM f GROUP BY review_id, scope""", ids="A6")
def eval_evidence_order(spark, d):
    from pyspark.sql.window import Window as W

    li = table(spark, d, "lineitem")
    seen = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    null = lambda kind: F.lit(None).cast(kind)
    caps = li.select(F.col("l_orderkey").alias("review_id"), F.lit("PRIMARY").alias("kind"), F.col("l_returnflag").alias("scope"), null("string").alias("scope_label"), F.lit("FINITE").alias("status"), F.lit(1.0).alias("value"), null("string").alias("unit"), null("string").alias("basis"), F.col("l_partkey").cast("string").alias("evidence_id"), seen.alias("seen"))
    return same_scope(caps, ["review_id"], order="seen").select("review_id", "scope", F.array_join("evidence", ",").alias("evidence"))


@query("error_envelope", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '{\"error\":{\"code\":\"NOT_FOUND\",\"message\":\"not found\"}}' WHEN o_orderstatus = 'O' THEN '{\"error\":{\"code\":\"FORBIDDEN\",\"message\":\"forbidden\"}}' END AS body FROM orders", ids="K9 Y14")
def error_envelope(spark, d):
    outcome = F.when(F.col("o_orderstatus") == "F", "NOT_FOUND").when(F.col("o_orderstatus") == "O", "FORBIDDEN").otherwise("OK")
    return table(spark, d, "orders").select("o_orderkey", report.error_envelope(outcome).alias("body"))


@query("draft_bundles", """WITH top AS (SELECT l_partkey AS requirement_id, max(l_linenumber) AS top FROM lineitem GROUP BY 1),
x AS (SELECT p_partkey AS requirement_id, coalesce(top, 0) + 1 AS version_number, p_type AS kind, CASE WHEN p_size % 7 > 0 THEN p_name END AS cs, p_brand AS mr, CASE WHEN p_size % 5 > 0 THEN p_type END AS er, CASE WHEN p_size % 2 > 0 THEN p_brand END AS lr FROM part LEFT JOIN top ON requirement_id = p_partkey)
SELECT requirement_id, CAST(version_number AS BIGINT) AS version_number, part, payload FROM (
  SELECT requirement_id, version_number, 'version' AS part, kind AS payload FROM x WHERE cs IS NOT NULL AND er IS NOT NULL UNION ALL SELECT requirement_id, version_number, 'company_standard', cs FROM x WHERE cs IS NOT NULL AND er IS NOT NULL
  UNION ALL SELECT requirement_id, version_number, 'mapping_rules', mr FROM x WHERE cs IS NOT NULL AND er IS NOT NULL UNION ALL SELECT requirement_id, version_number, 'evaluation_rules', er FROM x WHERE cs IS NOT NULL AND er IS NOT NULL
  UNION ALL SELECT requirement_id, version_number, 'legal_rule', lr FROM x WHERE cs IS NOT NULL AND er IS NOT NULL AND lr IS NOT NULL
  UNION ALL SELECT requirement_id, version_number, 'refused', 'missing ' || concat_ws(', ', CASE WHEN cs IS NULL THEN 'company_standard' END, CASE WHEN er IS NULL THEN 'evaluation_rules' END) FROM x WHERE cs IS NULL OR er IS NULL)""", ids="O12 H15")
def draft_bundles(spark, d):
    c = F.col
    drafts = table(spark, d, "part").select(c("p_partkey").alias("requirement_id"), c("p_type").alias("evaluator_type"), F.when(c("p_size") % 7 > 0, c("p_name")).alias("company_standard"), c("p_brand").alias("mapping_rules"), F.when(c("p_size") % 5 > 0, c("p_type")).alias("evaluation_rules"), F.when(c("p_size") % 2 > 0, c("p_brand")).alias("legal_rule"))
    return admin.draft_bundles(drafts, table(spark, d, "lineitem").select(c("l_partkey").alias("requirement_id"), c("l_linenumber").alias("version_number")))


@query("upload_rejections", f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, CASE lang WHEN 'en' THEN '{uploads_of.PDF}' WHEN 'fr' THEN '{uploads_of.DOCX}' WHEN 'de' THEN 'text/plain' END AS declared, CASE doc_id % 3 WHEN 0 THEN '{uploads_of.PDF}' WHEN 1 THEN '{uploads_of.DOCX}' END AS actual FROM documents)
SELECT doc_id, CASE WHEN text = '' THEN 'EMPTY_FILE' WHEN strlen(text) > 3000 THEN 'FILE_TOO_LARGE' WHEN declared IS NULL OR declared = 'text/plain' THEN 'UNSUPPORTED_TYPE' WHEN actual IS NULL THEN 'UNRECOGNISED_CONTENT' WHEN actual <> declared THEN 'CONTENT_TYPE_MISMATCH' END AS rejection FROM u""", ids="S10")
def upload_rejections(spark, d):
    lang, k = F.col("lang"), F.col("doc_id") % 3
    declared = F.when(lang == "en", uploads_of.PDF).when(lang == "fr", uploads_of.DOCX).when(lang == "de", "text/plain")
    actual = F.when(k == 0, uploads_of.PDF).when(k == 1, uploads_of.DOCX)
    return table(spark, d, "documents").select("doc_id", uploads_of.rejection(F.col("text").cast("binary"), declared, actual, 3000).alias("rejection"))


@query("object_keys", "SELECT doc_id, sha256(text)[1:2] || '/' || sha256(text) || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '' END AS storage_key FROM documents WHERE text IS NOT NULL", ids="Z16")
def object_keys(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, "a file.PDF").otherwise("a file")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", sinks.object_key(F.col("text").cast("binary"), name).alias("storage_key"))


@query("log_lines", "SELECT event_id, event_type AS note, true AS without_token FROM events", ids="K8")
def log_lines(spark, d):
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("note"), F.col("event_type"), F.lit("api_token"), F.lit("x")).alias("fields"))
    line = sinks.log_lines(e, "fields")
    at = lambda path: F.get_json_object("value", path)
    return line.select(at("$.event_id").cast("long").alias("event_id"), at("$.fields.note").alias("note"), at("$.fields.api_token").isNull().alias("without_token"))


@query("inv_null_outcome", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A'", ids="I6")
def inv_null_outcome(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "A", "ACCEPTABLE").alias("rule_outcome"))
    return invariants.nulls(rows, "rule_outcome").drop("rule_outcome")


@query("operational_failures", "SELECT o_orderkey, o_orderstatus = 'P' AS alert FROM orders", ids="O16")
def operational_failures(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "ANALYSIS_FAILED").when(F.col("o_orderstatus") == "F", "RESOLVED")
    return table(spark, d, "orders").select("o_orderkey", rollup.operational_failure(status).alias("alert"))


@query("requirement_order", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part ORDER BY p_name, p_partkey LIMIT 100", ids="T8")
def requirement_order(spark, d):
    from pyspark.sql.window import Window as W

    first = report.page(table(spark, d, "part").select("p_partkey", "p_name"), 1, 100, F.col("p_name"), F.col("p_partkey"))
    return first.withColumn("place", F.row_number().over(W.orderBy("p_name", "p_partkey")).cast("long"))
