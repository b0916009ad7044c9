"""Configuration files and case files in JSON, read with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STANDARD = (
    "requirement_code string, evaluator_type string, configuration struct<document_type:string,applicability:string,expected_presence:string,preferred:double,unit:string,basis:string,scope_key:string,extraction:string>, "
    "mapping_rules string, legal_rule struct<rule_type:string,configuration:struct<deviation_outcome:string,unlimited_outcome:string,acceptable_max:double,approval_required_above:double>>"
)
CASE = (
    "id string, evaluator_type string, requirement_code string, required boolean, mapping_state string, evidence_count int, extraction_status string, "
    "caps array<struct<cap_kind:string,scope:string,scope_label:string,cap_status:string,cap_value:double,cap_unit:string,cap_basis:string,evidence_count:int>>, "
    "expect_finding_classification string, expect_evaluations array<struct<scope_key:string,scope_label:string,evaluation_kind:string,classification:string,rule_outcome:string>>"
)


def read_standards(spark: SparkSession, path: str) -> DataFrame:
    """One standard per file; an absent evaluator type means numeric comparison. Nested rules stay JSON text."""
    rows = spark.read.schema(STANDARD).json(path, multiLine=True)
    return rows.withColumn("evaluator_type", F.coalesce("evaluator_type", F.lit("NUMERIC_COMPARISON")))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, a list or one object per file, in order of file and place."""
    rows = spark.read.schema(CASE).json(path, multiLine=True)
    return rows.withColumn("required", F.coalesce("required", F.lit(True))).withColumn("extraction_status", F.coalesce("extraction_status", F.lit("COMPLETE")))


#: What an evaluation case says: name, kind and what stands for it where it is absent or null. The rest is ignored.
FIELDS = {
    "id": ("string", None), "evaluator_type": ("string", "NUMERIC_COMPARISON"), "required": ("boolean", True), "mapping_state": ("string", None), "expected_presence": ("string", None), "extraction_status": ("string", "COMPLETE"),
    "std_scope": ("string", None), "std_unit": ("string", None), "std_basis": ("string", None), "preferred": ("double", None), "has_rule": ("boolean", False), "scope_required": ("boolean", True),
    "comparable_scopes": ("array<string>", None), "comparable_bases": ("array<string>", None), "deviation_outcome": ("string", None), "unlimited_outcome": ("string", None), "approval_required_above": ("double", None), "acceptable_max": ("double", None),
    "caps": ("array<struct<kind:string,scope:string,scope_label:string,status:string,value:double,unit:string,basis:string,evidence_id:string>>", None),
    "expect": ("array<struct<evaluation_kind:string,scope_key:string,scope_label:string,classification:string,rule_outcome:string>>", None),
}


def read_json_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((file, place, item), (file, failure)): what JSON files below path hold, each a list of objects or one object.

    A file that is not JSON, or holds neither, is a failure and stops no other; Spark passes over files without a byte. Items stay as they are, whatever their
    fields; who reads them says which fields they need.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.try_parse_json(F.col("content").cast("string")).alias("v"))
    kind = F.schema_of_variant("v")
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(kind.startswith("OBJECT"), F.array("v"))
    failure = F.when(F.col("v").isNull(), "not JSON").when(items.isNull(), "neither a list nor an object")
    held = rows.select("file", items.alias("items"), failure.alias("failure"))
    return held.filter("failure is null").select("file", F.posexplode("items").alias("place", "item")), held.filter("failure is not null").select("file", "failure")


def typed(items: DataFrame, fields: dict = FIELDS) -> tuple[DataFrame, DataFrame]:
    """((file, place, fields...), (file, place, id, failure)) of items: a field that is there and of another kind, or an
    item that is no object or has no id, is a failure, named after the first such field; such an item is not used."""
    raw = lambda n: F.try_variant_get("item", f"$.{n}", "variant")
    got = {n: F.try_variant_get("item", f"$.{n}", kind) for n, (kind, _) in fields.items()}
    there = lambda n: raw(n).isNotNull() & (F.schema_of_variant(raw(n)) != "VOID")
    wrong = F.when(~F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False)), "no object")
    for n, (kind, _) in fields.items():
        wrong = wrong.when(there(n) & got[n].isNull(), f"{n}: no {kind.split('<')[0]}")
    wrong = wrong.when(got["id"].isNull(), "no id")
    cast = [F.coalesce(c, F.lit(fields[n][1])).alias(n) if fields[n][1] is not None else c.alias(n) for n, c in got.items()]
    rows = items.select("file", "place", *cast, wrong.alias("_wrong"))
    return rows.filter("_wrong is null").drop("_wrong"), rows.filter("_wrong is not null").select("file", "place", "id", F.col("_wrong").alias("failure"))


def judge(cases: DataFrame) -> DataFrame:
    """(id, evaluation_kind, scope_key, scope_label, verdict): what the evaluators make of each case, held against what it
    expects. Cases of no known evaluator give nothing, so that all they expect is absent."""
    from lexmill.operators import evaluate, report

    own = cases.withColumn("facts_status", F.col("extraction_status")).withColumn("candidates", F.array().cast("array<string>"))
    numeric = evaluate.judged(own.filter("evaluator_type = 'NUMERIC_COMPARISON'"), ["id"])
    presence = evaluate.evaluate_presence(own.filter("evaluator_type = 'PRESENCE'"), ["id"])
    fields, values = ["id", "evaluation_kind", "scope_key", "scope_label"], ["classification", "rule_outcome"]
    want = cases.select("id", F.explode("expect").alias("e")).select("id", "e.*")
    return report.difference(want, numeric.unionByName(presence).select(*fields, *values), fields, values)


def rules_of(standards: DataFrame, limit: int = 10_000) -> list:
    """Mapping rules of all standards, ready to be built into a plan; more than limit of them are refused, since a plan
    could not hold them."""
    from lexmill.operators.mapping import Rules

    rows = standards.select("requirement_code", "mapping_rules").orderBy("requirement_code").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} standards")
    return [Rules.parse(r["requirement_code"], json.loads(r["mapping_rules"] or "{}")) for r in rows]
