"""Versioned configuration: latest versions, publishing, snapshots by content, carry-forward, import plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.vocab import DOCUMENT_TYPES
from lexmill.operators.workflow import latest


def untyped(document_type: Column) -> Column:
    """Whether a standard declares no known document type; null counts."""
    return ~F.coalesce(document_type.isin(*DOCUMENT_TYPES), F.lit(False))


def applicable(items: DataFrame, document_type: Column) -> DataFrame:
    return items.filter(F.col("document_type") == document_type)


def snapshot_candidates(requirements: DataFrame, versions: DataFrame, standards: DataFrame, mappings: DataFrame, evaluations: DataFrame, legal: DataFrame) -> DataFrame:
    """Per active requirement the latest version ids of everything it pins, and why it may not be published.

    The legal rule may be absent; any other gap, an unusable threshold or an unknown document type is a reason.
    """
    active = requirements.filter(F.col("status") == "ACTIVE").select("requirement_id", "code")
    rows = active.join(latest(versions, ["requirement_id"]).select("requirement_id", "requirement_version_id"), "requirement_id", "left")

    def pin(df: DataFrame, id_: str, *more: str) -> DataFrame:
        return latest(df, ["requirement_version_id"]).select("requirement_version_id", id_, *more)

    rows = rows.join(pin(standards, "company_standard_version_id", "document_type"), "requirement_version_id", "left")
    rows = rows.join(pin(mappings, "mapping_rule_version_id", "confirm_threshold"), "requirement_version_id", "left")
    rows = rows.join(pin(evaluations, "evaluation_rule_version_id"), "requirement_version_id", "left")
    rows = rows.join(pin(legal, "legal_rule_version_id"), "requirement_version_id", "left")
    missing = F.concat_ws(", ", F.when(F.col("company_standard_version_id").isNull(), "company standard"), F.when(F.col("mapping_rule_version_id").isNull(), "mapping rules"), F.when(F.col("evaluation_rule_version_id").isNull(), "evaluation rules"))
    reason = (
        F.when(F.col("requirement_version_id").isNull(), "no version")
        .when(missing != "", F.concat(F.lit("missing "), missing))
        .when(F.col("confirm_threshold").isNull(), "mapping rules omit confirm_threshold")
        .when(F.col("document_type").isNull(), "no document_type")
        .when(untyped(F.col("document_type")), "unknown document_type")
    )
    return rows.withColumn("incomplete", reason)


def snapshot_hash(items: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """The digest of a snapshot: SHA-256 of its items as JSON with sorted fields, in order of their first column."""
    row = F.struct(*[F.col(c) for c in columns])
    ordered = F.sort_array(F.collect_list(row))
    fields = sorted(columns)
    listed = F.transform(ordered, lambda r: F.to_json(F.struct(*[r[c].alias(c) for c in fields]), {"ignoreNullFields": "false"}))
    digest = F.sha2(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")), 256).alias("snapshot_hash")
    return items.groupBy(*(keys or [])).agg(digest, F.count("*").alias("items"))


def new_snapshots(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """The snapshots whose content is not stored yet."""
    return candidates.join(stored.select("snapshot_hash"), "snapshot_hash", "left_anti")


def missing_parts(items: DataFrame, key: str, parts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(key, part) of items that pin something that is not there: each part is a column of ids with its name and the
    stored ids. A snapshot with such an item is broken; a null pins nothing."""
    found = [items.filter(F.col(c).isNotNull()).join(ids.select(F.col("id").alias(c)), c, "left_anti").select(key, F.lit(name).alias("part")) for c, (name, ids) in parts.items()]
    return reduce(DataFrame.union, found)


#: Fields of stored mapping rules.
RULES = "struct<confirm_threshold:int,exact_phrases:array<string>,aliases:array<string>,keyword_groups:array<array<string>>,negative_patterns:array<string>,section_heading_terms:array<string>,weights:map<string,int>>"


def snapshot_rules(items: DataFrame, stored: DataFrame) -> DataFrame:
    """(snapshot_id, code, rules) of the mapping rules that each snapshot pins, read from their JSON."""
    return items.join(stored, "mapping_rule_version_id").select("snapshot_id", "code", F.from_json("rules", RULES).alias("rules"))


def carry_forward(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A new version of each changed row: given values replace, all others are carried along."""
    c, n = current.alias("c"), changes.alias("n")
    rows = n.join(c, key)
    return rows.select(key, (F.col("c.version_number") + 1).cast("long").alias("version_number"), *[F.coalesce(F.col(f"n.{x}"), F.col(f"c.{x}")).alias(x) for x in columns])


def upsert_plan(files: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """For each file: create, unchanged or new_version; stored rows without a file are kept."""
    f, s = files.select(key, F.col(content).alias("__new")), stored.select(key, F.col(content).alias("__old"))
    rows = f.join(s, key, "full_outer")
    action = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "keep").when(F.col("__new") == F.col("__old"), "unchanged").otherwise("new_version")
    return rows.select(key, action.alias("action"))


def file_rejection(code: Column, kind: Column, configuration: Column, threshold: Column, preferred: Column, expected: Column) -> Column:
    """Why a standard's file is not imported, the first reason; null where it is."""
    return (
        F.when(F.coalesce(code, F.lit("")) == "", "no requirement_code")
        .when(~F.coalesce(kind.isin("NUMERIC_COMPARISON", "PRESENCE"), F.lit(False)), "unknown evaluator_type")
        .when(configuration.isNull(), "no configuration")
        .when(threshold.isNull(), "no confirm_threshold")
        .when((kind == "NUMERIC_COMPARISON") & preferred.isNull(), "no preferred value")
        .when((kind == "PRESENCE") & expected.isNull(), "no expected_presence")
    )
