"""Access, redaction and pages: customers stand for users, nations for roles, regions for permission groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import maps
from lexmill.functions import text as T
from lexmill.functions.vocab import EXACT_ONLY_KEYS, FORBIDDEN_KEYS, LEGAL_POSITION_FIELDS, PAYLOAD_MARKERS, SECRET_WORDS
from lexmill.operators import access, report
from lexmill.plans.registry import query, table

#: A user has the role of their nation and the next one; a role has permissions by its region and number.
USER_ROLES = "SELECT c_custkey AS user_id, unnest([c_nationkey, (c_nationkey + 1) % 25]) AS role_id FROM customer"
ROLE_PERMISSIONS = "SELECT n_nationkey AS role_id, r_name || '.' || unnest(CASE WHEN n_nationkey % 3 = 0 THEN ['view', 'decide'] ELSE ['view'] END) AS permission FROM nation JOIN region ON r_regionkey = n_regionkey"


def user_roles(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25)).alias("role_id"))


def role_permissions(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    verbs = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("view"), F.lit("decide"))).otherwise(F.array(F.lit("view")))
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return rows.select(F.col("n_nationkey").alias("role_id"), "r_name", F.explode(verbs).alias("verb")).select("role_id", F.concat_ws(".", "r_name", "verb").alias("permission"))


_PERMISSIONS = f"ur AS ({USER_ROLES}), rp AS ({ROLE_PERMISSIONS}), ep AS (SELECT DISTINCT user_id, permission FROM ur JOIN rp USING (role_id))"


@query("access_effective_permissions", f"WITH {_PERMISSIONS} SELECT user_id, string_agg(permission, ',' ORDER BY permission) AS permissions FROM ep GROUP BY user_id")
def access_effective_permissions(spark, d):
    return access.permission_sets(user_roles(spark, d), role_permissions(spark, d)).select("user_id", F.array_join("permissions", ",").alias("permissions"))


@query("access_authority_count", f"WITH {_PERMISSIONS} SELECT count(DISTINCT user_id) AS authorities FROM ep JOIN customer ON c_custkey = user_id WHERE permission = 'ASIA.decide' AND c_acctbal > 0")
def access_authority_count(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 0, "ACTIVE").otherwise("SUSPENDED").alias("status"))
    return access.authorities(users, access.effective_permissions(user_roles(spark, d), role_permissions(spark, d)), "ASIA.decide")


#: Orders as reviews: in legal review where finished; line items of a late line are escalated findings.
_SCOPED = "sc AS (SELECT o_orderkey AS review_id, o_custkey AS owner_id, o_orderstatus = 'P' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag <> 'R') AS in_legal_scope FROM orders)"


def scoped(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderstatus") == "P", "LEGAL_REVIEW").otherwise("PROCESSING").alias("status"))
    li = table(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("finding_id"), F.col("l_orderkey").alias("review_id"), "l_quantity", "l_returnflag")
    escalations = li.filter("l_quantity > 49").select("finding_id", F.when(F.col("l_returnflag") == "R", F.lit(1)).alias("withdrawn_at"))
    return access.legal_scope(o, li, escalations)


@query("access_legal_scope", f"WITH {_SCOPED} SELECT * FROM sc")
def access_legal_scope(spark, d):
    return scoped(spark, d).select("review_id", "owner_id", "in_legal_scope")


@query("access_visible_reviews", f"""WITH {_SCOPED}, {_PERMISSIONS}, asg AS (SELECT l_orderkey AS review_id, l_suppkey AS user_id FROM lineitem WHERE l_linestatus = 'O')
SELECT user_id, count(*) AS reviews FROM (SELECT owner_id AS user_id, review_id FROM sc JOIN customer ON c_custkey = owner_id UNION SELECT user_id, review_id FROM asg JOIN sc USING (review_id) UNION SELECT user_id, review_id FROM ep, sc WHERE permission = 'ASIA.decide' AND in_legal_scope) GROUP BY user_id""")
def access_visible_reviews(spark, d):
    perms = access.effective_permissions(user_roles(spark, d), role_permissions(spark, d))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    assigned = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review_id"), F.col("l_suppkey").alias("user_id"), F.when(F.col("l_linestatus") != "O", 1).alias("revoked_at"))
    return access.visible_counts(scoped(spark, d), users, assigned, perms, "ASIA.decide")


@query("access_caller_reviews", f"WITH {_SCOPED} SELECT review_id FROM sc WHERE owner_id = 7 OR in_legal_scope OR review_id IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey = 7)")
def access_caller_reviews(spark, d):
    assigned = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review_id"), F.col("l_suppkey").alias("user_id"), F.when(F.col("l_linestatus") != "O", 1).alias("revoked_at"))
    return access.visible_reviews(scoped(spark, d), 7, assigned, sees_legal=True).select("review_id")


@query("access_outcome", f"WITH {_SCOPED}, {_PERMISSIONS} SELECT review_id, CASE WHEN NOT in_legal_scope THEN 'NOT_FOUND' WHEN owner_id NOT IN (SELECT user_id FROM ep WHERE permission = 'ASIA.view') THEN 'FORBIDDEN' ELSE 'OK' END AS outcome FROM sc")
def access_outcome(spark, d):
    perms = access.effective_permissions(user_roles(spark, d), role_permissions(spark, d)).filter("permission = 'ASIA.view'").select(F.col("user_id").alias("owner_id"), F.lit(True).alias("permitted"))
    return scoped(spark, d).join(perms, "owner_id", "left").select("review_id", access.access_outcome(F.col("in_legal_scope"), F.col("permitted")).alias("outcome"))


@query("access_grant_guard", f"""WITH rp AS ({ROLE_PERMISSIONS}), s AS (SELECT role_id, list(permission ORDER BY permission) AS p FROM rp GROUP BY role_id),
g AS (SELECT a.role_id AS actor, b.role_id AS target, a.p AS ap, b.p AS tp FROM s a JOIN s b ON b.role_id = (a.role_id * 7) % 25)
SELECT actor, target, coalesce(array_to_string(list_sort(list_filter(tp, lambda x: NOT list_contains(ap, x))), ','), '') AS beyond, len(list_filter(tp, lambda x: NOT list_contains(ap, x))) = 0 AND NOT (list_contains(tp, 'ASIA.view') AND list_contains(tp, 'ASIA.decide')) AS allowed FROM g""")
def access_grant_guard(spark, d):
    sets = role_permissions(spark, d).groupBy("role_id").agg(F.sort_array(F.collect_set("permission")).alias("p"))
    a = sets.select(F.col("role_id").alias("actor"), F.col("p").alias("actor_permissions"), ((F.col("role_id") * 7) % 25).alias("target"))
    g = a.join(sets.select(F.col("role_id").alias("target"), F.col("p").alias("target_permissions")), "target")
    return access.grant_guard(g, "ASIA.view", "ASIA.decide").select("actor", "target", F.array_join("beyond", ",").alias("beyond"), "allowed")


@query("access_replace_set", f"""WITH rp AS ({ROLE_PERMISSIONS}), r AS (SELECT role_id, CASE WHEN role_id % 2 = 0 THEN permission ELSE permission || '.all' END AS permission FROM rp WHERE role_id % 5 > 0)
SELECT role_id, permission, CASE WHEN b.role_id IS NULL THEN 'add' WHEN r.role_id IS NULL THEN 'remove' ELSE 'keep' END AS change FROM rp b FULL OUTER JOIN r USING (role_id, permission)""")
def access_replace_set(spark, d):
    rp = role_permissions(spark, d)
    asked = rp.filter("role_id % 5 > 0").withColumn("permission", F.when(F.col("role_id") % 2 == 0, F.col("permission")).otherwise(F.concat("permission", F.lit(".all"))))
    return access.replace_set(rp, asked, "role_id", "permission")


@query("access_missing_grants", f"WITH rp AS ({ROLE_PERMISSIONS}) SELECT role_id, permission FROM rp WHERE role_id % 4 > 0")
def access_missing_grants(spark, d):
    rp = role_permissions(spark, d)
    return access.missing_rows(rp.union(rp), rp.filter("role_id % 4 = 0"), ["role_id", "permission"])


@query("session_valid", "SELECT event_id, event_type <> 'view' AND ts + INTERVAL 8 HOURS > TIMESTAMP '2024-01-15 00:00:00' AS valid FROM events")
def session_valid(spark, d):
    e = table(spark, d, "events")
    valid = access.session_valid(F.when(F.col("event_type") == "view", F.col("ts")), F.col("ts") + F.expr("interval 8 hours"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return e.select("event_id", valid.alias("valid"))


#: Log fields: keys that must go, that may stay, and values of every kind.
_FIELDS = [
    ("request_id", "r-1"), ("user_password", "x"), ("clause_count", "4"), ("mapping_state", "NONE"), ("state", "abc"), ("requirement_code", "LIAB"), ("code", "123"), ("raw-content", "text"), ("note", "scrypt$16$abc"),
    ("blob", "y" * 201), ("edge", "z" * 200), ("Authorization", "Bearer"), ("oidc_id_token", "t"), ("legal_rule_version_id", "7"), ("a.email", "q"), ("a.ok", "-----BEGIN KEY"), ("detail", "eyJhbGciOiJIUzI1NiJ9.x"), ("set-cookie", "c"), ("status", "OK"), (" Token ", "s"),
]


def _forbidden_sql(k: str) -> str:
    keys = ", ".join(f"'{x}'" for x in FORBIDDEN_KEYS)
    ends = " OR ".join(f"ends_with({k}, '_{x}')" for x in FORBIDDEN_KEYS if x not in EXACT_ONLY_KEYS)
    words = ", ".join(f"'{x}'" for x in SECRET_WORDS)
    return f"({k} IN ({keys}) OR raw IN ({keys}) OR list_has_any(string_split({k}, '_'), [{words}]) OR {ends})"


_MASK = "CASE WHEN regexp_matches(v, 'scrypt\\$|bcrypt\\$|\\$argon2|-----BEGIN|eyJ[A-Za-z0-9_-]{10,}\\.') THEN '[redacted]' WHEN length(v) > 200 THEN '[' || length(v) || ' chars omitted]' ELSE v END"


@query("redact_fields", "WITH f AS (SELECT key, v FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _FIELDS) + f""") t(key, v)), p AS (SELECT key, v, lower(trim(unnest(string_split(key, '.')))) AS raw FROM f), b AS (SELECT DISTINCT key FROM (SELECT key, raw, replace(raw, '-', '_') AS k FROM p) WHERE {_forbidden_sql('k')})
SELECT key, {_MASK} AS value FROM f WHERE key NOT IN (FROM b)""")
def redact_fields(spark, d):
    row = spark.createDataFrame([(dict(_FIELDS),)], "fields map<string,string>")
    return row.select(F.explode(maps.redact(F.col("fields"))).alias("key", "value"))


@query("redact_event_values", f"WITH e AS (SELECT event_id, props AS v FROM events) SELECT event_id, {_MASK} AS value FROM e")
def redact_event_values(spark, d):
    return table(spark, d, "events").select("event_id", maps.redact_value(F.col("props")).alias("value"))


_MESSAGES = [(1, "column x does not exist"), (2, "duplicate key DETAIL: Key (a)=(b)"), (3, "[SQL: select 1] [parameters: (1)]"), (4, "bad Failing row contains (1, secret) DETAIL: more"), (5, "w" * 250), (6, "token scrypt$1$2 DETAIL: x"), (7, "lines\nDETAIL: a\nb")]


@query("redact_exception", "WITH m AS (SELECT CAST(id AS BIGINT) AS id, m FROM (VALUES " + ", ".join(f"({i}, '{m}')" for i, m in _MESSAGES) + ") t(id, m)), c AS (SELECT id, m, least(" + ", ".join(f"CASE WHEN strpos(m, '{p}') > 0 THEN strpos(m, '{p}') ELSE 100000 END" for p in PAYLOAD_MARKERS) + f") AS cut FROM m), v AS (SELECT id, CASE WHEN cut = 100000 THEN trim(m) ELSE trim(trim(m[:cut - 1], ' ' || chr(10)) || ' [payload omitted]') END AS v FROM c) SELECT id, {_MASK} AS message FROM v")
def redact_exception(spark, d):
    return spark.createDataFrame(_MESSAGES, "id long, m string").select("id", maps.operator_message(F.col("m")).alias("message"))


@query("log_traceback", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, sha256(array_to_string(l[greatest(len(l) - 24, 1):], chr(10))) AS tail, CAST(least(len(l), 25) AS INTEGER) AS lines, CAST(least(len(l), 3) AS INTEGER) AS causes FROM l""", ids="T9")
def log_traceback(spark, d):
    lines = F.split("text", "\n", -1)
    rows = table(spark, d, "documents").select("doc_id", maps.traceback_tail(lines).alias("tail"), maps.cause_chain(lines).alias("causes"))
    return rows.select("doc_id", T.fingerprint(F.array_join("tail", "\n")).alias("tail"), F.size("tail").alias("lines"), F.size("causes").alias("causes"))


@query("omit_legal_position", "SELECT l_orderkey, l_linenumber, l_returnflag AS classification FROM lineitem")
def omit_legal_position(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("classification"), *[F.col("l_tax").alias(c) for c in LEGAL_POSITION_FIELDS])
    return access.omit_position(rows, permitted=False)


@query("audit_page", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 25")
def audit_page(spark, d):
    rows = access.omit_states(table(spark, d, "events").withColumn("before_state", F.col("props")), permitted=False).filter("event_type = 'purchase'")
    return report.page(rows, 2, 25, F.col("ts").desc(), F.col("event_id").desc()).select("event_id", "user_id", "event_type")


@query("page_with_total", "SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def page_with_total(spark, d):
    rows = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return report.page_with_total(rows, 0, 25, F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_orderkey", "o_custkey", "total")


@query("review_list_scoped", f"WITH {_SCOPED} SELECT review_id FROM sc WHERE (in_legal_scope OR owner_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def review_list_scoped(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("owner_id"), F.lit(True).alias("mine"))
    rows = scoped(spark, d).join(c, "owner_id", "left")
    return rows.filter(F.col("in_legal_scope") | F.coalesce("mine", F.lit(False))).select("review_id")


@query("functions_map_overlay", "SELECT 'alias' AS k, 2 AS v UNION ALL SELECT 'exact_phrase', 5 UNION ALL SELECT 'extra', 9")
def functions_map_overlay(spark, d):
    row = spark.range(1).select(F.create_map(F.lit("exact_phrase"), F.lit(5), F.lit("alias"), F.lit(3)).alias("a"), F.create_map(F.lit("alias"), F.lit(2), F.lit("extra"), F.lit(9)).alias("b"))
    return row.select(F.explode(maps.overlay(F.col("a"), F.col("b"))).alias("k", "v"))


@query("functions_content_id", "SELECT doc_id, sha256(concat_ws(':', CAST(doc_id AS VARCHAR), lang, source)) AS id FROM documents")
def functions_content_id(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_id(F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("id"))
