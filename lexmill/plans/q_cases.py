"""Case files: every part is an evaluation case, written to JSON files, read back and judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.plans.registry import query, table
from lexmill.sources import configs
from lexmill.sources.scratch import shared_folder

#: Cases in one file. One file of seven is cut short, one case of eleven brings a word where a number belongs, and one of
#: thirteen expects what does not come.
IN_FILE = 500


def written(spark, d) -> str:
    c = F.col
    numeric = c("p_partkey") % 3 > 0
    cap = F.struct(F.lit("PRIMARY").alias("kind"), F.lit("GENERAL").alias("scope"), F.lit("FINITE").alias("status"), c("p_size").cast("double").alias("value"), F.lit("MONTHS").alias("unit"), F.lit("FEES_PAID").alias("basis"), F.lit("e").alias("evidence_id"))
    classification = F.when(c("p_partkey") % 13 == 0, "CONFLICT").when(numeric, F.when(c("p_size") == 20, "MATCH").otherwise("DEVIATION")).when(c("p_size") % 2 == 0, "MATCH").otherwise("MISSING")
    outcome = F.when(numeric, F.when(c("p_size") == 20, "NOT_APPLICABLE").when(c("p_size") <= 30, "ACCEPTABLE").otherwise("APPROVAL_REQUIRED")).when(c("p_size") % 2 == 0, "ACCEPTABLE").otherwise("NOT_APPLICABLE")
    expect = F.array(F.struct(F.lit("PRIMARY").alias("evaluation_kind"), F.when(numeric, "GENERAL").otherwise("DEFAULT").alias("scope_key"), classification.alias("classification"), outcome.alias("rule_outcome")))
    case = F.struct(
        F.concat(F.lit("P"), c("p_partkey").cast("string")).alias("id"), F.when(~numeric, "PRESENCE").alias("evaluator_type"), F.when(c("p_size") % 2 == 0, "CONFIRMED").otherwise("NONE").alias("mapping_state"), F.lit("PRESENT").alias("expected_presence"),
        F.lit("GENERAL").alias("std_scope"), F.lit("MONTHS").alias("std_unit"), F.lit("FEES_PAID").alias("std_basis"), F.lit(20).alias("preferred"), F.lit(True).alias("has_rule"), F.lit(30).alias("acceptable_max"), F.lit(40.5).alias("approval_required_above"),
        F.when(numeric, F.array(cap)).alias("caps"), expect.alias("expect"), c("p_name").alias("note"), F.when(c("p_partkey") % 11 == 0, "soon").alias("drift"),
    )
    text = F.regexp_replace(F.regexp_replace(F.to_json(case), '"preferred":20(.*),"drift":"soon"', '"preferred":"soon"$1'), '"std_scope":"GENERAL"', F.when(numeric, F.lit('"std_scope":"GENERAL"')).otherwise(F.lit('"std_scope":null')))
    files = table(spark, d, "part").select(F.expr(f"p_partkey div {IN_FILE}").alias("f"), text.alias("t")).groupBy("f").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("t")), ","), F.lit("]")).alias("value"))
    cut = F.when(c("f") % 7 == 3, F.substring("value", 1, 100)).otherwise(c("value"))
    path = shared_folder(spark, "cases")
    files.withColumn("value", cut).write.partitionBy("f").text(path)
    return path


_NUMERIC = "p_partkey % 3 > 0"


@query("cases_judged", f"""SELECT 'P' || p_partkey AS id, CASE WHEN {_NUMERIC} THEN 'GENERAL' ELSE 'DEFAULT' END AS scope_key, CASE WHEN p_partkey % 13 = 0 THEN 'changed' ELSE 'same' END AS verdict FROM part WHERE (p_partkey // {IN_FILE}) % 7 <> 3 AND p_partkey % 11 > 0""", ids="S16 S17 O22 J18 Z27 Z28")
def cases_judged(spark, d):
    items, _ = configs.read_json_files(spark, written(spark, d))
    cases, _ = configs.typed(items)
    return configs.judge(cases).select("id", "scope_key", "verdict")


@query("cases_failed", f"""SELECT 'P' || p_partkey AS what, 'preferred: no double' AS failure FROM part WHERE (p_partkey // {IN_FILE}) % 7 <> 3 AND p_partkey % 11 = 0
UNION ALL SELECT DISTINCT 'file ' || p_partkey // {IN_FILE}, 'not JSON' FROM part WHERE (p_partkey // {IN_FILE}) % 7 = 3""", ids="S17 O22 A28")
def cases_failed(spark, d):
    """Files that could not be read and cases of another make, each a row of its own."""
    items, broken = configs.read_json_files(spark, written(spark, d))
    _, odd = configs.typed(items)
    name = F.concat(F.lit("file "), F.regexp_extract("file", r"/f=(\d+)/", 1))
    return odd.select(F.col("id").alias("what"), "failure").unionByName(broken.select(name.alias("what"), "failure"))
