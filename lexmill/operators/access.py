"""Permissions, visibility of objects, and omission of what a caller may not see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.vocab import LEGAL_POSITION_FIELDS
from lexmill.operators.workflow import active_escalations


def effective_permissions(user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """(user_id, permission): the union over a user's roles."""
    return user_roles.join(role_permissions, "role_id").select("user_id", "permission").distinct()


def permission_sets(user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    return effective_permissions(user_roles, role_permissions).groupBy("user_id").agg(F.sort_array(F.collect_set("permission")).alias("permissions"))


def legal_scope(reviews: DataFrame, findings: DataFrame, escalations: DataFrame) -> DataFrame:
    """reviews with in_legal_scope: in legal review, or with an active escalation of a finding."""
    raised = active_escalations(escalations).join(findings.select("finding_id", "review_id"), "finding_id").select("review_id").distinct().withColumn("__raised", F.lit(True))
    rows = reviews.join(raised, "review_id", "left")
    return rows.withColumn("in_legal_scope", (F.col("status") == "LEGAL_REVIEW") | F.coalesce("__raised", F.lit(False))).drop("__raised")


def grounds(scoped: DataFrame, users: DataFrame, assignments: DataFrame) -> DataFrame:
    """(user_id, review_id, in_legal_scope) of reviews that a user owns or has a live assignment to, each once."""
    own = scoped.join(users, scoped["owner_id"] == users["user_id"]).select("user_id", "review_id", "in_legal_scope")
    live = assignments.filter(F.col("revoked_at").isNull()).select("user_id", "review_id")
    return own.union(live.join(scoped, "review_id").select("user_id", "review_id", "in_legal_scope")).distinct()


def visible_reviews(scoped: DataFrame, user_id: int, assignments: DataFrame, sees_legal: bool) -> DataFrame:
    """The reviews that one user may see: own ones, live assignments, and those in legal scope with the permission."""
    live = assignments.filter(F.col("revoked_at").isNull() & (F.col("user_id") == user_id)).select("review_id").distinct().withColumn("__live", F.lit(True))
    rows = scoped.join(live, "review_id", "left")
    return rows.filter((F.col("owner_id") == user_id) | F.coalesce("__live", F.lit(False)) | (F.lit(sees_legal) & F.col("in_legal_scope"))).drop("__live")


def visible_counts(scoped: DataFrame, users: DataFrame, assignments: DataFrame, permissions: DataFrame, see_legal: str) -> DataFrame:
    """(user_id, reviews): how many reviews each user may see, for those who see any.

    Whoever sees legal reviews sees all of them, so those are counted once and not paired with every such user.
    """
    legal = permissions.filter(F.col("permission") == see_legal).select("user_id").distinct().withColumn("__legal", F.lit(True))
    all_legal = scoped.filter("in_legal_scope").agg(F.count("*").alias("n"))
    per = grounds(scoped, users, assignments).groupBy("user_id").agg(F.count("*").alias("__all"), F.count_if(~F.col("in_legal_scope")).alias("__other"))
    rows = per.join(legal, "user_id", "full_outer")
    n = F.when(F.col("__legal"), F.coalesce("__other", F.lit(0)) + all_legal.scalar()).otherwise(F.col("__all"))
    return rows.select("user_id", n.cast("long").alias("reviews")).filter("reviews > 0")


def access_outcome(visible: Column, permitted: Column) -> Column:
    """What a caller is told: an object out of sight does not exist, whatever they may do."""
    return F.when(~F.coalesce(visible, F.lit(False)), "NOT_FOUND").when(~F.coalesce(permitted, F.lit(False)), "FORBIDDEN").otherwise("OK")


def omit_position(rows: DataFrame, permitted: bool) -> DataFrame:
    """rows without the fields of an internal legal position; omitted, never null."""
    return rows if permitted else rows.drop(*LEGAL_POSITION_FIELDS)


def omit_states(audit: DataFrame, permitted: bool) -> DataFrame:
    return audit if permitted else audit.drop("before_state", "after_state")


def authorities(users: DataFrame, permissions: DataFrame, legal: str) -> DataFrame:
    """How many active users hold the permission."""
    return users.filter(F.col("status") == "ACTIVE").join(permissions.filter(F.col("permission") == legal), "user_id").agg(F.countDistinct("user_id").alias("authorities"))


def grant_guard(grants: DataFrame, bypass: str, legal: str) -> DataFrame:
    """grants (actor_permissions, target_permissions) with what the actor lacks and whether the grant stands.

    Nobody hands out more than they hold, and a bypass never reaches legal authority.
    """
    rows = grants.withColumn("beyond", F.sort_array(F.array_except("target_permissions", "actor_permissions")))
    both = F.array_contains("target_permissions", bypass) & F.array_contains("target_permissions", legal)
    return rows.withColumn("allowed", (F.size("beyond") == 0) & ~both)


def replace_set(before: DataFrame, requested: DataFrame, parent: str, item: str) -> DataFrame:
    """(parent, item, change): what replacing a set adds, removes and keeps."""
    b, r = before.select(parent, item).distinct().withColumn("__b", F.lit(True)), requested.select(parent, item).distinct().withColumn("__r", F.lit(True))
    rows = b.join(r, [parent, item], "full_outer")
    return rows.select(parent, item, F.when(F.col("__b").isNull(), "add").when(F.col("__r").isNull(), "remove").otherwise("keep").alias("change"))


def session_valid(revoked_at: Column, expires_at: Column, now: Column) -> Column:
    """Whether a session holds: neither revoked nor past its end."""
    return revoked_at.isNull() & F.coalesce(expires_at > now, F.lit(False))


def missing_rows(requested: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The requested rows that are not stored yet: grants, catalogues, evidence links."""
    return requested.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
