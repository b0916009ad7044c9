"""Reads: orders stand for reviews and versions, line items for findings and evaluations, parts for requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import reads, report
from lexmill.plans.q_access import role_permissions, user_roles
from lexmill.plans.registry import query, table

#: A line of an order is a finding, its suppliers' copies of that line its evaluations.
_FINDING = "l_orderkey || ':' || l_linenumber"
_EVALUATION = "l_partkey || ':' || l_suppkey"


def lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.withColumn("finding_id", F.concat_ws(":", "l_orderkey", "l_linenumber")).withColumn("evaluation_id", F.concat_ws(":", "l_partkey", "l_suppkey"))


@query("contract_list", "SELECT c_custkey AS contract_id, c_nationkey AS owner_id, c_name AS name, c_mktsegment AS contract_type FROM customer WHERE c_nationkey = 7 ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 25", ids="H1 F4 F15 T6")
def contract_list(spark, d):
    c = F.col
    rows = table(spark, d, "customer").select(c("c_custkey").alias("contract_id"), c("c_nationkey").alias("owner_id"), c("c_name").alias("name"), c("c_mktsegment").alias("contract_type"), c("c_acctbal").alias("created_at"))
    return reads.resource(report.page(rows.filter("owner_id = 7"), 1, 25, *reads.list_order("contract")), "contract").drop("created_at")


@query("version_read", "SELECT o_orderkey AS version_id, o_custkey AS contract_id, o_orderpriority AS file_hash, o_orderstatus AS processing_status FROM orders", ids="H2 F15")
def version_read(spark, d):
    c = F.col
    rows = table(spark, d, "orders").select(c("o_orderkey").alias("version_id"), c("o_custkey").alias("contract_id"), c("o_orderpriority").alias("file_hash"), c("o_orderstatus").alias("processing_status"), F.lit("ab/key").alias("storage_key"))
    return reads.resource(rows, "version")


@query("review_list", "SELECT o_orderkey AS review_id, o_custkey AS contract_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 50", ids="H3 F1 F15 T6")
def review_list(spark, d):
    c = F.col
    rows = table(spark, d, "orders").select(c("o_orderkey").alias("review_id"), c("o_custkey").alias("contract_id"), c("o_orderstatus").alias("status"), c("o_orderdate").alias("created_at"))
    return report.page(reads.resource(reads.filtered(rows, "review", status="O", contract_id=None), "review"), 2, 50, *reads.list_order("review")).drop("created_at")


@query("evaluation_places", f"""SELECT {_FINDING} AS finding_id, {_EVALUATION} AS evaluation_id, row_number() OVER (PARTITION BY {_FINDING} ORDER BY l_returnflag, l_linestatus, coalesce(CASE WHEN l_tax > 0.04 THEN 'label' END, ''), l_partkey, l_suppkey) AS place FROM lineitem""", ids="T2 T3")
def evaluation_places(spark, d):
    label = F.concat(F.coalesce(F.when(F.col("l_tax") > 0.04, "label"), F.lit("")), F.lit(" "), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0"))
    rows = lines(spark, d).select("finding_id", "evaluation_id", F.col("l_returnflag").alias("evaluation_kind"), F.col("l_linestatus").alias("scope_key"), label.alias("scope_label"))
    return reads.evaluation_order(rows, ["finding_id"]).select("finding_id", "evaluation_id", "place")


@query("finding_requirements", f"""SELECT {_FINDING} AS finding_id, {_EVALUATION} AS evaluation_id, p_brand AS code, p_name AS name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size % 4 > 0""", ids="J7")
def finding_requirements(spark, d):
    c = F.col
    part = table(spark, d, "part")
    versions = part.filter("p_size % 4 > 0").select(c("p_partkey").alias("requirement_version_id"), c("p_partkey").alias("requirement_id"), c("p_name").alias("name"), c("p_size").alias("version_number"))
    findings = lines(spark, d).withColumn("requirement_version_id", c("l_partkey"))
    return reads.finding_requirements(findings, versions, part.select(c("p_partkey").alias("requirement_id"), c("p_brand").alias("code"))).select("finding_id", "evaluation_id", "code", "name")


_EVIDENCE = "CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 END"


def evidence_of(spark, d):
    li = lines(spark, d).withColumn("evidence_id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    evidence = reads.told_apart(li.select("evidence_id", F.expr("if(l_suppkey % 3 > 0, l_suppkey % 3, null)").alias("page_number"), F.col("l_partkey").alias("start_offset"), F.col("l_returnflag").alias("content")), "evidence_id")
    return reads.finding_evidence(reads.told_apart(li.select("finding_id", "evidence_id", F.lit("PRIMARY").alias("relationship_type")), "evidence_id"), evidence)


@query("finding_evidence", f"""WITH e AS (SELECT DISTINCT {_FINDING} AS finding_id, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS evidence_id, {_EVIDENCE} AS page, l_partkey AS place FROM lineitem)
SELECT finding_id, string_agg(evidence_id, ',' ORDER BY page NULLS LAST, place, evidence_id) AS evidence FROM e GROUP BY finding_id""", ids="J8 T4")
def finding_evidence(spark, d):
    return evidence_of(spark, d).select("finding_id", F.array_join(F.transform("evidence", lambda e: e["evidence_id"]), ",").alias("evidence"))


@query("findings_nested", f"""WITH e AS (SELECT DISTINCT {_FINDING} AS finding_id, l_orderkey AS review_id, l_linestatus AS scope, {_EVALUATION} AS evaluation_id, l_returnflag AS classification FROM lineitem),
v AS (SELECT DISTINCT {_FINDING} AS finding_id, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS evidence_id FROM lineitem), n AS (SELECT finding_id, count(*) AS evidence FROM v GROUP BY finding_id)
SELECT finding_id, any_value(review_id) AS review_id, string_agg(scope || '=' || evaluation_id || '=' || classification, ',' ORDER BY scope, evaluation_id, classification) AS evaluations, any_value(evidence) AS evidence, any_value(review_id) % 3 = 0 AS requires_decision FROM e JOIN n USING (finding_id) GROUP BY finding_id""", ids="H4 H6 J7 J8 F15 F18")
def findings_nested(spark, d):
    li = lines(spark, d)
    findings = reads.told_apart(li.select("finding_id", F.col("l_orderkey").alias("review_id"), F.when(F.col("l_orderkey") % 3 == 0, "DECISION_REQUIRED").otherwise("OPEN").alias("status")), "finding_id")
    evaluations = reads.told_apart(li.select("finding_id", F.col("l_linestatus").alias("scope_key"), "evaluation_id", F.col("l_returnflag").alias("classification"), F.lit("NOT_APPLICABLE").alias("rule_outcome"), F.lit(False).alias("requires")), "finding_id")
    rows = reads.findings_with_parts(findings, evaluations, evidence_of(spark, d))
    listed = F.array_join(F.transform("evaluations", lambda e: F.concat_ws("=", e["scope_key"], e["evaluation_id"], e["classification"])), ",")
    return rows.select("finding_id", "review_id", listed.alias("evaluations"), F.size("evidence").cast("long").alias("evidence"), "requires_decision")


@query("findings_page", f"""WITH f AS (SELECT DISTINCT {_FINDING} AS finding_id, l_orderkey AS review_id, l_shipdate AS created_at, l_returnflag AS classification FROM lineitem WHERE l_returnflag = 'R')
SELECT finding_id, review_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at, finding_id LIMIT 100""", ids="H4 F1 T6 A14")
def findings_page(spark, d):
    rows = lines(spark, d).select("finding_id", F.col("l_orderkey").alias("review_id"), F.col("l_shipdate").alias("created_at"), F.col("l_returnflag").alias("classification")).distinct()
    return report.page_with_total(reads.filtered(rows, "finding", classification="R", status=None), 1, 500, *reads.list_order("finding")).select("finding_id", "review_id", "total")


@query("evaluation_evidence_ids", f"SELECT evaluation_id, string_agg(e, ',' ORDER BY e) AS evidence_ids FROM (SELECT DISTINCT {_EVALUATION} AS evaluation_id, CAST(l_orderkey AS VARCHAR) AS e FROM lineitem) GROUP BY evaluation_id", ids="Y10")
def evaluation_evidence_ids(spark, d):
    links = lines(spark, d).select("evaluation_id", F.col("l_orderkey").cast("string").alias("evidence_id"))
    return reads.evidence_ids(links).select("evaluation_id", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("requirement_list", """WITH v AS (SELECT DISTINCT l_partkey AS p, l_linenumber AS n, l_returnflag AS f FROM lineitem WHERE l_partkey % 5 > 0)
SELECT p_partkey AS requirement_id, p_brand AS code, coalesce(string_agg(n || f, ',' ORDER BY n, f), '') AS versions FROM part LEFT JOIN v ON p = p_partkey GROUP BY p_partkey, p_brand""", ids="H8 F15")
def requirement_list(spark, d):
    c = F.col
    versions = table(spark, d, "lineitem").filter("l_partkey % 5 > 0").select(c("l_partkey").alias("requirement_id"), c("l_linenumber").alias("version_number"), c("l_returnflag").alias("name")).distinct()
    rows = reads.requirement_versions(table(spark, d, "part").select(c("p_partkey").alias("requirement_id"), c("p_brand").alias("code")), versions)
    return rows.select("requirement_id", "code", F.array_join(F.transform("versions", lambda v: F.concat(v["version_number"].cast("string"), v["name"])), ",").alias("versions"))


def roles(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("role_id"), F.col("n_name").alias("code"), F.col("n_name").alias("name"))


@query("user_list", """WITH ur AS (SELECT DISTINCT c_custkey AS user_id, unnest([c_nationkey, (c_nationkey + 1) % 25]) AS role_id FROM customer)
SELECT c_custkey AS user_id, c_name AS name, string_agg(n_name, ',' ORDER BY n_name) AS roles FROM customer JOIN ur ON user_id = c_custkey JOIN nation ON n_nationkey = role_id GROUP BY c_custkey, c_name""", ids="H10 Y1 J13 F15")
def user_list(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lit("secret").alias("credential_hash"))
    return reads.users_with_roles(users, user_roles(spark, d), roles(spark, d)).select("user_id", "name", F.array_join("roles", ",").alias("roles"))


@query("role_list", """WITH rp AS (SELECT n_nationkey AS role_id, r_name || '.' || unnest(CASE WHEN n_nationkey % 3 = 0 THEN ['view', 'decide'] ELSE ['view'] END) AS permission FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT role_id, n_name AS code, string_agg(permission, ',' ORDER BY permission) AS permissions, coalesce(string_agg(permission, ',' ORDER BY permission) FILTER (WHERE permission LIKE '%.decide'), '') AS confers_legal_authority FROM rp JOIN nation ON n_nationkey = role_id GROUP BY role_id, n_name""", ids="H10 F15 F18")
def role_list(spark, d):
    legal = [f"{r}.decide" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]
    rows = reads.roles_with_permissions(roles(spark, d), role_permissions(spark, d), legal)
    return rows.select("role_id", "code", F.array_join("permissions", ",").alias("permissions"), F.array_join("confers_legal_authority", ",").alias("confers_legal_authority"))
