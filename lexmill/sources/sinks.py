"""Sinks that only ever add: content-addressed objects, append-only tables, guarded publishing, log lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.maps import redact
from lexmill.functions.text import fingerprint, suffix
from lexmill.operators import invariants as inv
from lexmill.operators.invariants import require_empty
from lexmill.sources.manifest import Store


def object_key(content: Column, name: Column) -> Column:
    """Where an object is stored: by its hash, spread over folders by its first two digits."""
    digest = fingerprint(content)
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, suffix(name))


#: So many keys at most are looked up as values of a filter.
KEYS_AT_HAND = 1000


def put_objects(files: DataFrame, path: str) -> int:
    """Store objects under their keys, each once, whoever else is storing them; the number of the commit.

    What is stored is never written again, and nothing is overwritten. Of an upload only the objects whose keys the
    store lacks are left; keys are looked for in the folders whose range of keys meets that of the upload.
    """
    keyed = files.withColumn("storage_key", object_key(F.col("content"), F.col("name")))
    return Store(files.sparkSession, path).publish(uuid.uuid4().hex, {"": keyed}, {"": ["storage_key"]}, stored="skip", options={"parquet.bloom.filter.enabled#storage_key": "true"})


def stored_objects(spark: SparkSession, path: str, keys: DataFrame | None = None, content: bool = True) -> DataFrame:
    """What is stored below path, or the objects of those storage keys; a key without an object has no row.

    Up to KEYS_AT_HAND keys go to the scan as values: of each folder only the parts whose range of keys and filter may
    hold one are read. More are met by a join. Without content its column is not read.
    """
    rows = Store(spark, path).table("")
    if rows is None:
        rows = spark.createDataFrame([], "name string, content binary, storage_key string")
    rows = rows if content else rows.drop("content")
    if keys is None:
        return rows
    asked = keys.select("storage_key").filter("storage_key is not null").distinct()
    few = [r["storage_key"] for r in asked.limit(KEYS_AT_HAND + 1).collect()]
    return rows.filter(F.col("storage_key").isin(few)) if len(few) <= KEYS_AT_HAND else rows.join(asked, "storage_key")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str], run: str | None = None) -> int:
    """Append the rows whose keys are not stored; rows of one key are stored once. The number of the commit.

    A run that was appended before is not written again, and nothing is read for it but the log. Otherwise keys are
    looked for in the folders whose range of the first key meets that of the rows: a batch of keys beyond those stored
    reads none of them, however much is stored.
    """
    return Store(rows.sparkSession, path).publish(run or uuid.uuid4().hex, {"": rows}, {"": keys}, stored="skip")


def publish_analysis(findings: DataFrame, evaluations: DataFrame, path: str, run: str) -> int:
    """Findings with their evaluations as one commit, after the checks that a database would make; its number.

    A run that is published is not written again, one that broke off was never there, and findings that another run has
    stored are refused, also where that run is published at the same time.
    """

    def check(staged: dict[str, DataFrame]) -> set[str]:
        f, e = staged["findings"], staged["evaluations"]
        require_empty(**inv.unpaired(f, e, "finding_id"), evidence=inv.lacking_evidence(e), outcome=inv.nulls(e, "rule_outcome"))
        return {"findings"}

    named = {"findings": findings.withColumn("run", F.lit(run)), "evaluations": evaluations.withColumn("run", F.lit(run))}
    try:
        return Store(findings.sparkSession, path).publish(run, named, {"findings": ["finding_id"]}, check=check)
    except inv.InvariantBroken as broken:
        raise inv.InvariantBroken(str(broken).replace("findings: stored already", "finding_stored")) from broken


def published_evaluations(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The evaluations of all runs that are published, or were as of a commit."""
    return Store(spark, path).table("evaluations", version)


def log_lines(events: DataFrame, fields: str) -> DataFrame:
    """Events as JSON lines whose fields (a string map) are redacted first."""
    safe = events.withColumn(fields, redact(F.col(fields)))
    return safe.select(F.to_json(F.struct(*safe.columns)).alias("value"))
