"""What readers are shown: resources without what is internal, findings with all that belongs to them, list orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Columns of the resources that may be shown. A version has no storage key, a user no credentials.
SHOWN = {
    "contract": ("contract_id", "owner_id", "name", "contract_type", "status", "created_at", "updated_at"),
    "version": ("version_id", "contract_id", "version_number", "original_filename", "mime_type", "file_size_bytes", "file_hash", "processing_status", "extraction_status", "uploaded_by", "created_at"),
    "review": ("review_id", "contract_id", "version_id", "snapshot_id", "status", "created_by", "created_at", "started_at", "completed_at"),
    "user": ("user_id", "email", "name", "status", "created_at"),
    "role": ("role_id", "code", "name"),
    "session": ("user_id", "email", "name", "status", "permissions"),
}
#: Filters that lists take, by resource; any other is refused.
FILTERS = {"review": ("status", "contract_id"), "finding": ("classification", "status"), "audit": ("action", "entity_type", "entity_id", "actor_id"), "user": ("status",), "requirement": ("status",)}


def resource(rows: DataFrame, kind: str) -> DataFrame:
    """The columns of a resource that may be shown, as far as rows has them."""
    return rows.select(*[c for c in SHOWN[kind] if c in rows.columns])


def filtered(rows: DataFrame, kind: str, **asked) -> DataFrame:
    """rows that equal every value asked for; None asks for nothing, an unlisted filter is an error."""
    for name, value in asked.items():
        if name not in FILTERS[kind]:
            raise ValueError(f"{kind} lists have no filter {name}")
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def list_order(kind: str) -> list[Column]:
    """The order of a list: newest first, but findings as they arose, users by email, roles and requirements by code."""
    c = F.col
    return {
        "review": [c("created_at").desc(), c("review_id").desc()], "contract": [c("created_at").desc(), c("contract_id").desc()], "audit": [c("timestamp").desc(), c("event_id").desc()],
        "finding": [c("created_at"), c("finding_id")], "user": [c("email"), c("user_id")], "role": [c("code"), c("role_id")], "requirement": [c("code")],
    }[kind]


def evaluation_order(evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """evaluations with their place in each group: by kind, scope and label, an absent label first."""
    w = W.partitionBy(*keys).orderBy("evaluation_kind", "scope_key", F.coalesce("scope_label", F.lit("")))
    return evaluations.withColumn("place", F.row_number().over(w).cast("long"))


def finding_requirements(findings: DataFrame, versions: DataFrame, requirements: DataFrame) -> DataFrame:
    """findings with the code, name and version number of their requirement; null where it is gone."""
    named = versions.join(requirements.select("requirement_id", "code"), "requirement_id").select("requirement_version_id", "code", "name", "version_number")
    return findings.join(named, "requirement_version_id", "left")


def told_apart(rows: DataFrame, key: str) -> DataFrame:
    """The distinct rows, each in the partition of its key, so that what follows by that key moves nothing again. Copies
    meet before the shuffle."""
    own = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.collect_set(own).alias("__rows")).select(key, F.explode("__rows").alias("__row")).select(key, "__row.*")


def finding_evidence(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(finding_id, evidence): the linked evidence with its relation, in order of page (none last) and offset."""
    rows = links.join(evidence, "evidence_id")
    item = F.struct(F.col("page_number").isNull().alias("none"), "page_number", "start_offset", "evidence_id", "relationship_type", "content")
    return rows.groupBy("finding_id").agg(F.sort_array(F.collect_list(item)).alias("evidence"))


def findings_with_parts(findings: DataFrame, evaluations: DataFrame, evidence: DataFrame) -> DataFrame:
    """findings with evaluations (by scope, then id) and evidence as arrays; either may be empty, neither is null.

    A finding's parts are as many as its requirement has scopes and mapped clauses, so they fit one row.
    """
    item = F.struct("scope_key", "evaluation_id", "classification", "rule_outcome", "requires")
    per = evaluations.groupBy("finding_id").agg(F.sort_array(F.collect_list(item)).alias("evaluations"))
    rows = findings.join(per, "finding_id", "left").join(evidence, "finding_id", "left")
    for name in ("evaluations", "evidence"):
        kind = rows.schema[name].dataType
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return rows.withColumn("requires_decision", F.col("status").isin("DECISION_REQUIRED", "AWAITING_CLARIFICATION"))


def evidence_ids(links: DataFrame) -> DataFrame:
    """(evaluation_id, evidence_ids), ascending."""
    return links.groupBy("evaluation_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"))


def requirement_versions(requirements: DataFrame, versions: DataFrame) -> DataFrame:
    """requirements with their versions in order; a requirement without any has none."""
    per = versions.groupBy("requirement_id").agg(F.sort_array(F.collect_list(F.struct("version_number", "name"))).alias("versions"))
    rows = requirements.join(per, "requirement_id", "left")
    return rows.withColumn("versions", F.coalesce("versions", F.array().cast(rows.schema["versions"].dataType)))


def users_with_roles(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """users as resources with the codes of their roles in order."""
    per = user_roles.join(roles.select("role_id", "code"), "role_id").groupBy("user_id").agg(F.sort_array(F.collect_set("code")).alias("roles"))
    return resource(users, "user").join(per, "user_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))


def roles_with_permissions(roles: DataFrame, role_permissions: DataFrame, legal: list[str]) -> DataFrame:
    """roles with their permissions, and those among them that confer legal authority, in order."""
    per = role_permissions.groupBy("role_id").agg(F.sort_array(F.collect_set("permission")).alias("permissions"))
    rows = resource(roles, "role").join(per, "role_id", "left").withColumn("permissions", F.coalesce("permissions", F.array().cast("array<string>")))
    return rows.withColumn("confers_legal_authority", F.array_intersect("permissions", F.array(*[F.lit(p) for p in legal])))
