"""Changes to users, roles, sessions, contracts and drafts, as rows to store or refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.vocab import DOCUMENT_TYPES
from lexmill.operators.access import effective_permissions


def holders(users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, legal: str) -> DataFrame:
    """(user_id) of the active users who hold a permission."""
    held = effective_permissions(user_roles, role_permissions.filter(F.col("permission") == legal))
    return users.filter(F.col("status") == "ACTIVE").join(held, "user_id", "left_semi").select("user_id")


def update_users(users: DataFrame, changes: DataFrame, sessions: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, legal: str) -> DataFrame:
    """changes (user_id, name, status; null keeps) as rows of users with what follows: refused, sessions_revoked.

    All changes are one step. If active users held the legal permission before it and none would after it, every change
    that takes a holder away is refused. A user who is no longer active loses all live sessions.
    """
    before = holders(users, user_roles, role_permissions, legal)
    rows = changes.alias("c").join(users.alias("u"), "user_id").select("user_id", F.coalesce("c.name", "u.name").alias("name"), F.coalesce("c.status", "u.status").alias("status"), F.col("c.status").alias("asked"))
    ends = F.coalesce(F.col("asked") != "ACTIVE", F.lit(False))
    lost = rows.filter(ends).select("user_id").join(before, "user_id", "left_semi").withColumn("holder", F.lit(True))
    left = before.join(rows.filter(ends).select("user_id"), "user_id", "left_anti").limit(1).agg(F.count("*").alias("n"))
    live = sessions.filter(F.col("revoked_at").isNull()).groupBy("user_id").agg(F.count("*").alias("live"))
    out = rows.join(lost, "user_id", "left").join(live, "user_id", "left")
    refused = F.coalesce("holder", F.lit(False)) & (left.scalar() == 0)
    out = out.withColumn("refused", F.when(refused, "last legal authority"))
    return out.select("user_id", "name", "status", "refused", F.when(ends & F.col("refused").isNull(), F.coalesce("live", F.lit(0))).otherwise(0).cast("long").alias("sessions_revoked"))


def revoke_roles(revocations: DataFrame, users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, legal: str) -> DataFrame:
    """revocations (user_id, role_id), each judged alone: absent, refused (it would take the last active holder of the
    legal permission) or revoked, and the audit action that goes with it."""
    before = holders(users, user_roles, role_permissions, legal)
    legal_roles = role_permissions.filter(F.col("permission") == legal).select("role_id").distinct().withColumn("legal", F.lit(True))
    # How many of a user's roles give the permission: the last of them is what counts.
    ways = user_roles.distinct().join(legal_roles, "role_id").groupBy("user_id").agg(F.count("*").alias("ways"))
    held = user_roles.distinct().withColumn("held", F.lit(True))
    rows = revocations.join(held, ["user_id", "role_id"], "left").join(legal_roles, "role_id", "left").join(ways, "user_id", "left").join(before.withColumn("holder", F.lit(True)), "user_id", "left")
    total = before.agg(F.count("*").alias("n")).scalar()
    last = F.coalesce("legal", F.lit(False)) & F.coalesce("holder", F.lit(False)) & (F.col("ways") == 1) & (total == 1)
    outcome = F.when(F.col("held").isNull(), "absent").when(last, "refused").otherwise("revoked")
    rows = rows.withColumn("outcome", outcome)
    action = F.when(F.col("outcome") == "revoked", F.when(F.coalesce("legal", F.lit(False)), "authz.legal_authority_revoked").otherwise("authz.role_revoked"))
    return rows.select("user_id", "role_id", "outcome", action.alias("action"))


def end_sessions(sessions: DataFrame, whose: DataFrame, at: Column) -> DataFrame:
    """sessions with the live ones of those users ended; the end of others stays as it is."""
    hit = whose.select("user_id").distinct().withColumn("hit", F.lit(True))
    rows = sessions.join(hit, "user_id", "left")
    return rows.withColumn("revoked_at", F.when(F.col("hit") & F.col("revoked_at").isNull(), at).otherwise(F.col("revoked_at"))).drop("hit")


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the given fields of changes put in; a null field keeps what was there."""
    r, c = rows.alias("r"), changes.select(key, *columns).alias("c")
    joined = r.join(c, key, "left")
    return joined.select(*[F.coalesce(F.col(f"c.{x}"), F.col(f"r.{x}")).alias(x) if x in columns else F.col(key if x == key else f"r.{x}").alias(x) for x in rows.columns])


def create_requirements(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (request_id, code) with refused: no code, a code that exists, or one that an earlier request takes."""
    first = requests.filter(F.coalesce(F.trim("code"), F.lit("")) != "").groupBy("code").agg(F.min("request_id").alias("first"))
    rows = requests.join(first, "code", "left").join(stored.select("code", F.lit(True).alias("had")).distinct(), "code", "left")
    reason = F.when(F.coalesce(F.trim("code"), F.lit("")) == "", "no code").when(F.col("had"), "code exists").when(F.col("request_id") != F.col("first"), "code taken")
    return rows.select("request_id", "code", reason.alias("refused"))


def draft_bundles(drafts: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of the next version of each drafted requirement: the version itself and, at version 1 of it, its standard,
    mapping rules, evaluation rules and, if it has one, legal rule.

    drafts: requirement_id, evaluator_type, company_standard, mapping_rules, evaluation_rules, legal_rule, one of each.
    A draft that lacks a mandatory part could never be published: it has one row, with the reason.
    """
    top = versions.groupBy("requirement_id").agg(F.max("version_number").alias("top"))
    parts = ("company_standard", "mapping_rules", "evaluation_rules")
    lacks = F.concat_ws(", ", *[F.when(F.col(p).isNull(), F.lit(p)) for p in parts])
    rows = drafts.join(top, "requirement_id", "left").withColumn("version_number", (F.coalesce("top", F.lit(0)) + 1).cast("long")).withColumn("lacks", lacks)
    row = lambda part, payload: F.struct(F.lit(part).alias("part"), payload.cast("string").alias("payload"))
    made = F.array(row("version", F.col("evaluator_type")), *[row(p, F.col(p)) for p in parts], F.when(F.col("legal_rule").isNotNull(), row("legal_rule", F.col("legal_rule"))))
    refused = F.array(row("refused", F.concat(F.lit("missing "), F.col("lacks"))))
    return rows.select("requirement_id", "version_number", F.explode(F.array_compact(F.when(F.col("lacks") == "", made).otherwise(refused))).alias("row")).select("requirement_id", "version_number", "row.*")


def contract_type_valid(kind: Column) -> Column:
    """A contract may leave its type open; a declared one has to be known, as it is written."""
    return kind.isNull() | kind.isin(*DOCUMENT_TYPES)


def denials(requests: DataFrame) -> DataFrame:
    """Audit rows of requests that were turned away (outcome NOT_FOUND or FORBIDDEN): who, what and the permission that
    was missing; none of the object's contents, and no permission where the object was out of sight."""
    hidden = F.col("outcome") == "NOT_FOUND"
    action = F.when(hidden, "authz.object_not_visible").otherwise("authz.permission_denied")
    return requests.filter(F.col("outcome").isin("NOT_FOUND", "FORBIDDEN")).select("request_id", "actor_id", action.alias("action"), "entity_type", "entity_id", F.when(~hidden, F.col("permission")).alias("permission"))


def login_outcomes(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """attempts (attempt_id, email, credential_ok) with what the caller is told and what is recorded.

    The caller learns one thing only, whether they are in; the audit row tells an unknown name from a wrong credential
    and an account that is not active.
    """
    rows = attempts.join(users.select("email", "user_id", "status"), "email", "left")
    reason = F.when(F.col("user_id").isNull(), "unknown").when(~F.coalesce("credential_ok", F.lit(False)), "credential").when(F.col("status") != "ACTIVE", "inactive")
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.select("attempt_id", "user_id", F.when(ok, "OK").otherwise("FAILED").alias("outcome"), F.when(ok, "auth.login").otherwise("auth.login_failed").alias("action"), "reason")
