"""Administration: customers stand for users and contracts, nations for roles, events for requests and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import admin
from lexmill.plans.q_access import _PERMISSIONS, role_permissions, user_roles
from lexmill.plans.registry import query, table

_USERS = "u AS (SELECT c_custkey AS user_id, c_name AS name, CASE WHEN c_acctbal > 0 THEN 'ACTIVE' ELSE 'SUSPENDED' END AS status, c_mktsegment AS segment FROM customer)"


def users(spark, d):
    c = F.col
    return table(spark, d, "customer").select(c("c_custkey").alias("user_id"), c("c_name").alias("name"), F.when(c("c_acctbal") > 0, "ACTIVE").otherwise("SUSPENDED").alias("status"), c("c_mktsegment").alias("segment"))


def sessions(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("session_id"), "user_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"), "ts")


@query("user_updates", f"""WITH {_PERMISSIONS}, {_USERS}, holders AS (SELECT DISTINCT user_id FROM ep JOIN u USING (user_id) WHERE permission = 'ASIA.decide' AND status = 'ACTIVE'),
ch AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'new ' || name END AS name, CASE WHEN segment = 'BUILDING' THEN 'DISABLED' WHEN user_id % 5 = 0 THEN 'ACTIVE' END AS status FROM u WHERE segment IN ('BUILDING', 'MACHINERY')),
remain AS (SELECT count(*) AS n FROM holders WHERE user_id NOT IN (SELECT user_id FROM ch WHERE status = 'DISABLED')), live AS (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id),
r AS (SELECT ch.user_id, coalesce(ch.name, u.name) AS name, coalesce(ch.status, u.status) AS status, ch.status = 'DISABLED' AS ends, CASE WHEN ch.status = 'DISABLED' AND ch.user_id IN (FROM holders) AND (SELECT n FROM remain) = 0 THEN 'last legal authority' END AS refused FROM ch JOIN u USING (user_id))
SELECT r.user_id, name, status, refused, CASE WHEN ends AND refused IS NULL THEN coalesce(live.n, 0) ELSE 0 END AS sessions_revoked FROM r LEFT JOIN live ON live.user_id = r.user_id""", ids="Y1 F22 O18")
def user_updates(spark, d):
    u = users(spark, d)
    asked = F.when(F.col("segment") == "BUILDING", "DISABLED").when(F.col("user_id") % 5 == 0, "ACTIVE")
    changes = u.filter("segment in ('BUILDING', 'MACHINERY')").select("user_id", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("new "), "name")).alias("name"), asked.alias("status"))
    return admin.update_users(u.drop("segment"), changes, sessions(spark, d), user_roles(spark, d), role_permissions(spark, d), "ASIA.decide")


@query("role_revocations", f"""WITH {_PERMISSIONS}, {_USERS}, legal AS (SELECT DISTINCT role_id FROM rp WHERE permission = 'ASIA.decide'), urd AS (SELECT DISTINCT user_id, role_id FROM ur),
holders AS (SELECT DISTINCT user_id FROM ep JOIN u USING (user_id) WHERE permission = 'ASIA.decide' AND status = 'ACTIVE'), ways AS (SELECT user_id, count(*) AS n FROM urd WHERE role_id IN (FROM legal) GROUP BY user_id),
q AS (SELECT c_custkey AS user_id, (c_nationkey + c_custkey % 3) % 25 AS role_id FROM customer),
o AS (SELECT q.*, q.role_id IN (FROM legal) AS is_legal, CASE WHEN urd.user_id IS NULL THEN 'absent' WHEN q.role_id IN (FROM legal) AND q.user_id IN (FROM holders) AND ways.n = 1 AND (SELECT count(*) FROM holders) = 1 THEN 'refused' ELSE 'revoked' END AS outcome
  FROM q LEFT JOIN urd ON urd.user_id = q.user_id AND urd.role_id = q.role_id LEFT JOIN ways ON ways.user_id = q.user_id)
SELECT user_id, role_id, outcome, CASE WHEN outcome = 'revoked' THEN CASE WHEN is_legal THEN 'authz.legal_authority_revoked' ELSE 'authz.role_revoked' END END AS action FROM o""", ids="Y2 O18 H16")
def role_revocations(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), ((F.col("c_nationkey") + F.col("c_custkey") % 3) % 25).cast("int").alias("role_id"))
    return admin.revoke_roles(asked, users(spark, d), user_roles(spark, d), role_permissions(spark, d), "ASIA.decide")


@query("sessions_end", "SELECT event_id AS session_id, CASE WHEN event_type = 'error' THEN ts WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' END AS revoked_at FROM events", ids="Y3")
def sessions_end(spark, d):
    s = sessions(spark, d)
    at = F.lit("2024-03-01 00:00:00").cast(s.schema["revoked_at"].dataType)
    return admin.end_sessions(s, s.filter("user_id % 3 = 0").select("user_id"), at).select("session_id", "revoked_at")


@query("contract_patch", "SELECT c_custkey AS contract_id, CASE WHEN c_custkey % 4 = 0 THEN 'renamed' ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN 'ACTIVE' ELSE c_mktsegment END AS status FROM customer", ids="Y4")
def contract_patch(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("contract_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))
    changes = rows.filter("contract_id % 2 = 0").select("contract_id", F.when(F.col("contract_id") % 4 == 0, "renamed").alias("name"), F.when(F.col("contract_id") % 6 == 0, "ACTIVE").alias("status"))
    return admin.patch(rows, changes, "contract_id", ["name", "status"])


@query("requirement_create", """WITH q AS (SELECT p_partkey AS request_id, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_brand END AS code FROM part), had AS (SELECT DISTINCT p_brand AS code FROM part WHERE p_partkey % 50 = 0), first AS (SELECT code, min(request_id) AS first FROM q WHERE trim(code) <> '' GROUP BY code)
SELECT request_id, code, CASE WHEN trim(code) = '' THEN 'no code' WHEN code IN (FROM had) THEN 'code exists' WHEN request_id <> first THEN 'code taken' END AS refused FROM q LEFT JOIN first USING (code)""", ids="Y4 H15 J15")
def requirement_create(spark, d):
    part = table(spark, d, "part")
    asked = part.select(F.col("p_partkey").alias("request_id"), F.when(F.col("p_size") % 9 == 0, " ").otherwise(F.col("p_brand")).alias("code"))
    return admin.create_requirements(asked, part.filter("p_partkey % 50 = 0").select(F.col("p_brand").alias("code")))


@query("contract_type_valid", "SELECT doc_id, CASE lang WHEN 'en' THEN true WHEN 'fr' THEN false WHEN 'de' THEN true ELSE true END AS valid FROM documents", ids="Y13 F7")
def contract_type_valid(spark, d):
    kind = F.when(F.col("lang") == "en", "MSA").when(F.col("lang") == "fr", "msa").when(F.col("lang") == "de", "OTHER")
    return table(spark, d, "documents").select("doc_id", admin.contract_type_valid(kind).alias("valid"))


@query("denial_audit", """SELECT event_id AS request_id, user_id AS actor_id, CASE WHEN event_type = 'view' THEN 'authz.object_not_visible' ELSE 'authz.permission_denied' END AS action, 'review' AS entity_type, user_id * 7 AS entity_id,
CASE WHEN event_type = 'click' THEN 'decision.create' END AS permission FROM events WHERE event_type IN ('view', 'click')""", ids="Y7 K4")
def denial_audit(spark, d):
    outcome = F.when(F.col("event_type") == "view", "NOT_FOUND").when(F.col("event_type") == "click", "FORBIDDEN").otherwise("OK")
    return admin.denials(table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("actor_id"), outcome.alias("outcome"), F.lit("review").alias("entity_type"), (F.col("user_id") * 7).alias("entity_id"), F.lit("decision.create").alias("permission")))


@query("login_outcomes", f"""WITH {_USERS}, a AS (SELECT event_id AS attempt_id, 'Customer#' || user_id AS email, event_type <> 'error' AS ok FROM events), m AS (SELECT 'Customer#' || user_id AS email, user_id, status FROM u WHERE user_id % 2 = 0)
SELECT attempt_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN user_id IS NOT NULL AND ok AND status = 'ACTIVE' THEN 'OK' ELSE 'FAILED' END AS outcome, CASE WHEN user_id IS NOT NULL AND ok AND status = 'ACTIVE' THEN 'auth.login' ELSE 'auth.login_failed' END AS action,
CASE WHEN user_id IS NULL THEN 'unknown' WHEN NOT ok THEN 'credential' WHEN status <> 'ACTIVE' THEN 'inactive' END AS reason FROM a LEFT JOIN m USING (email)""", ids="O20 F22")
def login_outcomes(spark, d):
    attempts = table(spark, d, "events").select(F.col("event_id").alias("attempt_id"), F.concat(F.lit("Customer#"), F.col("user_id").cast("string")).alias("email"), (F.col("event_type") != "error").alias("credential_ok"))
    known = users(spark, d).filter("user_id % 2 = 0").withColumn("email", F.concat(F.lit("Customer#"), F.col("user_id").cast("string")))
    return admin.login_outcomes(attempts, known).withColumn("user_id", F.col("user_id").cast("string"))
