"""Versioned configuration: parts stand for requirements, line items for their versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import config_store, report, workflow
from lexmill.plans.registry import query, table


def versions(spark, d):
    """(requirement_id, version_number, value): the deliveries of a part, in order of order and line."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("requirement_id"), (F.col("l_orderkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("version_number"), F.col("l_quantity").alias("value"))


_V = "SELECT l_partkey AS requirement_id, l_orderkey * 100000 + l_suppkey * 10 + l_linenumber AS version_number, l_quantity AS value FROM lineitem"


@query("config_latest_version", f"WITH v AS ({_V}) SELECT requirement_id, max(version_number) AS version_number, arg_max(value, version_number) AS value FROM v GROUP BY requirement_id")
def config_latest_version(spark, d):
    return workflow.latest(versions(spark, d), ["requirement_id"])


_PUB = """
WITH req AS (SELECT p_partkey AS requirement_id, p_name AS code FROM part WHERE p_size % 3 > 0),
rv AS (SELECT l_partkey AS requirement_id, max(l_orderkey * 100000 + l_suppkey * 10 + l_linenumber) AS rv FROM lineitem WHERE l_partkey % 11 > 0 GROUP BY 1),
items AS (SELECT requirement_id, code, rv, CASE WHEN rv % 13 > 0 THEN rv + 1 END AS cs, CASE WHEN rv % 17 > 0 THEN rv + 2 END AS mr, CASE WHEN rv % 19 > 0 THEN rv + 3 END AS er, CASE WHEN rv % 2 = 0 THEN rv + 4 END AS lr, CASE rv % 7 WHEN 0 THEN NULL WHEN 1 THEN 'msa' ELSE 'MSA' END AS kind, CASE WHEN rv % 23 > 0 THEN 5 END AS threshold FROM req LEFT JOIN rv USING (requirement_id)),
miss AS (SELECT *, concat_ws(', ', CASE WHEN cs IS NULL THEN 'company standard' END, CASE WHEN mr IS NULL THEN 'mapping rules' END, CASE WHEN er IS NULL THEN 'evaluation rules' END) AS missing FROM items),
done AS (SELECT *, CASE WHEN rv IS NULL THEN 'no version' WHEN missing <> '' THEN 'missing ' || missing WHEN threshold IS NULL THEN 'mapping rules omit confirm_threshold' WHEN kind IS NULL THEN 'no document_type' WHEN kind <> 'MSA' THEN 'unknown document_type' END AS incomplete FROM miss)"""


def candidates(spark, d):
    req = table(spark, d, "part").select(F.col("p_partkey").alias("requirement_id"), F.col("p_name").alias("code"), F.when(F.col("p_size") % 3 > 0, "ACTIVE").otherwise("DRAFT").alias("status"))
    v = versions(spark, d).filter("requirement_id % 11 > 0").select("requirement_id", "version_number", F.col("version_number").alias("requirement_version_id"))
    rv = F.col("requirement_version_id")

    def pins(name: str, add: int, mod: int, *more):
        # Two versions of each; the earlier ones have ids that may not come up.
        first = v.filter(rv % mod > 0) if mod else v.filter(rv % 2 == 0)
        rows = first.select("requirement_version_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version_number"), *more)
        return rows.withColumn(name, F.when(F.col("version_number") == 2, rv + add).otherwise(F.lit(-1)))

    kind = F.when(rv % 7 == 1, "msa").when(rv % 7 != 0, "MSA").alias("document_type")
    return config_store.snapshot_candidates(req, v, pins("company_standard_version_id", 1, 13, kind), pins("mapping_rule_version_id", 2, 17, F.when(rv % 23 > 0, 5).alias("confirm_threshold")), pins("evaluation_rule_version_id", 3, 19), pins("legal_rule_version_id", 4, 0))


@query("config_publish_complete", _PUB + " SELECT requirement_id, code, incomplete FROM done")
def config_publish_complete(spark, d):
    return candidates(spark, d).select("requirement_id", "code", "incomplete")


_HASH = _PUB + """, i AS (SELECT requirement_id % 8 AS shard, requirement_id AS a, coalesce(CAST(lr AS VARCHAR), 'null') AS b, rv AS c FROM done WHERE incomplete IS NULL)
SELECT shard, sha256('[' || string_agg('{"a":' || a || ',"b":' || b || ',"c":' || c || '}', ', ' ORDER BY a) || ']') AS snapshot_hash, count(*) AS items FROM i GROUP BY shard"""


@query("config_snapshot_hash", _HASH)
def config_snapshot_hash(spark, d):
    rows = candidates(spark, d).filter("incomplete is null").select((F.col("requirement_id") % 8).alias("shard"), F.col("requirement_id").alias("a"), F.col("legal_rule_version_id").alias("b"), F.col("requirement_version_id").alias("c"))
    return config_store.snapshot_hash(rows, ["a", "b", "c"], ["shard"])


@query("config_new_snapshots", _HASH.replace("SELECT shard, sha256", ", h AS (SELECT shard, sha256").replace("GROUP BY shard", "GROUP BY shard)") + " SELECT shard FROM h WHERE shard >= 3")
def config_new_snapshots(spark, d):
    h = config_snapshot_hash(spark, d)
    return config_store.new_snapshots(h, h.filter("shard < 3")).select("shard")


@query("config_carry_forward", f"WITH v AS ({_V}), l AS (SELECT requirement_id, max(version_number) AS version_number, arg_max(value, version_number) AS value FROM v GROUP BY requirement_id) SELECT requirement_id, version_number + 1 AS version_number, CASE WHEN p_size > 25 THEN p_retailprice ELSE value END AS value, p_brand AS brand FROM l JOIN part ON p_partkey = requirement_id WHERE p_size % 2 = 0")
def config_carry_forward(spark, d):
    part = table(spark, d, "part")
    current = workflow.latest(versions(spark, d), ["requirement_id"]).join(part.select(F.col("p_partkey").alias("requirement_id"), F.col("p_brand").alias("brand")), "requirement_id")
    changes = part.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("requirement_id"), F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("value"), F.lit(None).cast("string").alias("brand"))
    return config_store.carry_forward(current, changes, "requirement_id", ["value", "brand"])


@query("config_upsert_plan", "WITH f AS (SELECT p_partkey AS code, CASE WHEN p_size % 5 = 0 THEN 'new' ELSE p_name END AS n FROM part WHERE p_partkey % 4 > 0), s AS (SELECT p_partkey AS code, p_name AS o FROM part WHERE p_partkey % 3 > 0) SELECT code, CASE WHEN o IS NULL THEN 'create' WHEN n IS NULL THEN 'keep' WHEN n = o THEN 'unchanged' ELSE 'new_version' END AS action FROM f FULL OUTER JOIN s USING (code)")
def config_upsert_plan(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("code"), "p_name", "p_size")
    files = part.filter("code % 4 > 0").withColumn("content", F.when(F.col("p_size") % 5 == 0, "new").otherwise(F.col("p_name")))
    return config_store.upsert_plan(files, part.filter("code % 3 > 0").withColumn("content", F.col("p_name")), "code", "content")


@query("config_untyped", "SELECT lang, lang NOT IN ('MSA', 'OTHER') OR lang IS NULL AS untyped, count(*) AS n FROM (SELECT CASE lang WHEN 'en' THEN 'MSA' WHEN 'fr' THEN 'OTHER' WHEN 'de' THEN 'msa' END AS lang FROM documents) GROUP BY lang")
def config_untyped(spark, d):
    lang = F.when(F.col("lang") == "en", "MSA").when(F.col("lang") == "fr", "OTHER").when(F.col("lang") == "de", "msa")
    rows = table(spark, d, "documents").select(lang.alias("lang"))
    return rows.groupBy("lang").agg(F.count("*").alias("n")).withColumn("untyped", config_store.untyped(F.col("lang")))


@query("config_file_validation", """SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 'no requirement_code' WHEN p_size % 9 = 1 THEN 'unknown evaluator_type' WHEN p_size % 9 = 2 THEN 'no configuration' WHEN p_size % 9 = 3 THEN 'no confirm_threshold' WHEN p_size % 9 = 4 THEN 'no preferred value' WHEN p_size % 9 = 5 THEN 'no expected_presence' END AS rejection FROM part""")
def config_file_validation(spark, d):
    k = F.col("p_size") % 9
    kind = F.when(k == 1, "GUESS").when(k == 5, "PRESENCE").otherwise("NUMERIC_COMPARISON")
    r = config_store.file_rejection(F.when(k != 0, F.col("p_name")), kind, F.when(k != 2, "{}"), F.when(k != 3, 5), F.when(~k.isin(4, 5), 1.0), F.when(k != 5, "PRESENT"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r.alias("rejection"))


@query("snapshot_items", "SELECT o_orderkey, c_name, n_name, r_name, s_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 300")
def snapshot_items(spark, d):
    t = lambda n: table(spark, d, n)
    o = t("orders").select("o_orderkey", "o_custkey")
    rows = o.join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.join(t("supplier"), F.col("s_suppkey") == F.col("o_orderkey") % 300, "left").select("o_orderkey", "c_name", "n_name", "r_name", "s_name")


@query("config_page", "SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_size > 10) AS total FROM part WHERE p_size > 10 ORDER BY p_name, p_partkey LIMIT 100 OFFSET 100")
def config_page(spark, d):
    rows = table(spark, d, "part").filter("p_size > 10").select("p_partkey", "p_name")
    return report.page_with_total(rows, 2, 500, F.col("p_name"), F.col("p_partkey"))
