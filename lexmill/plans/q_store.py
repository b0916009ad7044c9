"""What is stored: published runs, objects, consumed streams. Each query writes to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import append_only
from lexmill.operators.invariants import InvariantBroken
from lexmill.plans import q_ingest
from lexmill.plans.registry import query, table
from lexmill.sources import sinks
from lexmill.sources.manifest import Store
from lexmill.sources.scratch import shared_folder
from lexmill.streaming import analyze


@query("published_findings", """WITH e AS (SELECT l_orderkey || ':' || l_partkey AS finding_id, o_orderstatus AS run FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT finding_id, run, count(*) AS evaluations FROM e GROUP BY finding_id, run""", ids="K3 R2 I4")
def published_findings(spark, d):
    """Reviews of one status are a run. One run comes twice, one brings findings that are stored, one lacks evidence: none
    of these three adds a row to either table."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"))
    kind = F.when(F.col("l_returnflag") == "R", "DEVIATION").when(F.col("l_returnflag") == "A", "MISSING").otherwise("MATCH")
    rows = table(spark, d, "lineitem").join(orders, "l_orderkey").select(
        F.concat_ws(":", "l_orderkey", "l_partkey").alias("finding_id"), "status", kind.alias("classification"), F.lit("NOT_APPLICABLE").alias("rule_outcome"), F.array(F.col("l_linenumber").cast("string")).alias("evidence")
    )
    path = shared_folder(spark, "findings")
    # Six runs take their rows from here: joined once, not once for each table of each run.
    rows.write.parquet(f"{path}/in")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/in")

    def publish(run, status, evidence=F.col("evidence")):
        own = rows.filter(F.col("status") == status).drop("status").withColumn("evidence", evidence)
        sinks.publish_analysis(own.select("finding_id").distinct(), own, path, run)

    for status in ("F", "O", "P", "F"):
        publish(status, status)
    for run, evidence in (("again", F.col("evidence")), ("bare", F.array().cast("array<string>"))):
        try:
            publish(run, "P", evidence)
            raise AssertionError(f"{run} was published")
        except InvariantBroken:
            pass
    return sinks.published_evaluations(spark, path).groupBy("finding_id", "run").agg(F.count("*").alias("evaluations"))


@query("objects_stored", "SELECT sha256(text)[1:2] || '/' || sha256(text) || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '' END AS storage_key, CAST(min(strlen(text)) AS INTEGER) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1", ids="K1 S11")
def objects_stored(spark, d):
    """One language is stored first, then all documents; each object is there once."""
    name = F.when(F.col("doc_id") % 2 == 0, "a file.PDF").otherwise("a file")
    files = table(spark, d, "documents").filter("text is not null").select(name.alias("name"), F.col("text").cast("binary").alias("content"), "lang")
    path = shared_folder(spark, "objects")
    for part in (files.filter("lang = 'en'"), files, files):
        sinks.put_objects(part.drop("lang"), path)
    return sinks.stored_objects(spark, path).select("storage_key", F.octet_length("content").alias("bytes"))


@query("ingest_published", f"""WITH {q_ingest._STORED}, {q_ingest._RUNS},
n AS (SELECT l_orderkey AS version_id, count(DISTINCT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS n FROM lineitem GROUP BY 1)
SELECT upload_id AS version_id, CASE WHEN failed THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN failed THEN 0 ELSE coalesce(n, 0) END AS evidence FROM up JOIN runs r ON r.version_id = upload_id LEFT JOIN n ON n.version_id = upload_id""", ids="K2")
def ingest_published(spark, d):
    """Versions, their runs and the evidence of the runs that read something, as one commit."""
    versions = q_ingest.ingest_versions(spark, d)
    runs = q_ingest.runs(spark, d).join(versions.select("version_id"), "version_id")
    li = table(spark, d, "lineitem")
    seg = li.select(F.col("l_orderkey").alias("version_id"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"), F.col("l_linenumber").alias("page_number"), F.col("l_partkey").alias("start_offset")).distinct()
    evidence = q_ingest.ingest.evidence_rows(seg, runs).select("run_id", "evidence_id", "place")
    store = Store(spark, shared_folder(spark, "ingest"))
    unique = {"versions": ["version_id"], "runs": ["run_id"], "evidence": ["run_id", "evidence_id"]}
    for _ in range(2):
        store.publish("upload", {"versions": versions, "runs": runs, "evidence": evidence}, unique)
    n = store.table("evidence").groupBy("run_id").agg(F.count("*").alias("evidence"))
    rows = store.table("versions").select("version_id").join(store.table("runs"), "version_id").join(n, "run_id", "left")
    return rows.select("version_id", "status", F.coalesce("evidence", F.lit(0).cast("long")).alias("evidence"))


@query("events_consumed", "SELECT event_id, user_id, event_type FROM events", ids="R2")
def events_consumed(spark, d):
    """Events come as a stream of files, all of them twice; each is stored once."""
    path = shared_folder(spark, "events")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    rows.repartitionByRange(6, "event_id").write.parquet(f"{path}/in")
    for run in ("first", "again"):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(f"{path}/in")
        work = lambda batch, n: analyze.consume(batch, n, lambda b: b, f"{path}/out", ["event_id"])
        stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{path}/{run}").trigger(availableNow=True).start().awaitTermination()
    return Store(spark, f"{path}/out").table("")


@query("objects_found", """WITH k AS (SELECT sha256(text)[1:2] || '/' || sha256(text) || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '' END AS storage_key, lang, strlen(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT storage_key, bool_or(lang <> 'fr') AS stored FROM k WHERE lang IN ('fr', 'de') GROUP BY storage_key""".replace("bool_or(lang <> 'fr')", "storage_key IN (SELECT storage_key FROM k WHERE lang <> 'fr' OR lang IS NULL)"), ids="S11")
def objects_found(spark, d):
    """Documents of all languages but one are stored; which of the keys of two languages are there, without reading any
    content."""
    name = F.when(F.col("doc_id") % 2 == 0, "a file.PDF").otherwise("a file")
    files = table(spark, d, "documents").filter("text is not null").select(name.alias("name"), F.col("text").cast("binary").alias("content"), "lang")
    path = shared_folder(spark, "objects")
    sinks.put_objects(files.filter("lang <> 'fr' or lang is null").drop("lang"), path)
    asked = files.filter("lang in ('fr', 'de')").select(sinks.object_key(F.col("content"), F.col("name")).alias("storage_key")).distinct()
    there = sinks.stored_objects(spark, path, asked, content=False).select("storage_key", F.lit(True).alias("there"))
    return asked.join(there, "storage_key", "left").select("storage_key", F.coalesce("there", F.lit(False)).alias("stored"))


@query("events_append_only", """SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'lost' ELSE 'changed' END AS verdict FROM events WHERE event_id % 97 = 0 OR user_id % 41 = 3
UNION ALL SELECT -1 - user_id, 'backdated' FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 43 = 5)""", ids="I2")
def events_append_only(spark, d):
    """A later copy of the events that lost some, changed those of some users, and brings others that pretend to be old."""
    old = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    kept = old.filter("event_id % 97 <> 0").withColumn("value", F.expr("if(user_id % 41 = 3, coalesce(value, 0) + 1, value)"))
    odd = old.filter("user_id % 43 = 5").groupBy("user_id").agg(F.min("ts").alias("ts"), F.min("event_type").alias("event_type"), F.min("value").alias("value"))
    new = kept.unionByName(odd.select((-1 - F.col("user_id")).alias("event_id"), "user_id", "ts", "event_type", "value"))
    return append_only.departures(old, new, ["event_id"])
