"""Analysis of documents as they come in: at-least-once delivery, each result stored once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import mapping
from lexmill.operators.segment import lines
from lexmill.sources.manifest import Store
from lexmill.sources.sinks import append_new


def map_batch(documents: DataFrame, rules: Sequence[mapping.Rules]) -> DataFrame:
    """(doc_id, requirement, state, best, qualifying) of a batch of documents."""
    scored = mapping.score(lines(documents), rules, signals=False)
    found = mapping.state(scored, ["doc_id"], F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line_no").cast("string")))
    return found.select("doc_id", "requirement", "state", "best", "qualifying")


def same_version(messages: DataFrame, fingerprint: str) -> DataFrame:
    """Messages for this version of the evaluators; one without a fingerprint fits any."""
    return messages.filter(F.col("fingerprint").isNull() | (F.col("fingerprint") == fingerprint))


def consume(batch: DataFrame, number: int, work: Callable[[DataFrame], DataFrame], out: str, keys: list[str]) -> int:
    """Append what work makes of a batch of a stream, once; the number of the commit.

    The query's id, which its checkpoint keeps, and the batch's number name the run.
    """
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    run = f"{query}:{number}"
    store = Store(batch.sparkSession, out)
    if (done := store.version_of(run)) is not None:
        return done
    return append_new(work(batch), out, keys, run)


def start(documents: DataFrame, rules: Sequence[mapping.Rules], out: str, checkpoint: str, **trigger):
    """Map a stream of documents into the table at out.

    A batch that is delivered again after a failure is known by its query and number and not even worked out; documents
    that come again in another batch find their (document, requirement) pairs stored and add nothing.
    """

    def store(batch: DataFrame, number: int) -> None:
        consume(batch, number, lambda rows: map_batch(rows, rules), out, ["doc_id", "requirement"])

    return documents.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def audit_feed(events: DataFrame, at: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of audit events by hour and type from an append-only stream; events later than late are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"))
