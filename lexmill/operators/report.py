"""Reports, pages and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.vocab import TIER_1

MAX_PAGE, DEFAULT_PAGE = 100, 25


def page(rows: DataFrame, number: int = 1, size: int = DEFAULT_PAGE, *order: Column) -> DataFrame:
    """One page of rows in order; sizes above MAX_PAGE and numbers below 1 are brought into range."""
    size, number = max(1, min(size, MAX_PAGE)), max(1, number)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page with the number of all rows beside each of its own."""
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, number, size, *order).withColumn("total", total.scalar())


def envelope(rows: Column, number: int, size: int, total: Column) -> Column:
    """A page as a JSON envelope."""
    return F.to_json(F.struct(rows.alias("data"), F.struct(F.lit(number).alias("page"), F.lit(size).alias("page_size"), total.alias("total")).alias("pagination")))


def error_envelope(outcome: Column) -> Column:
    """What a caller is told about a request that was turned away, as JSON; null where it was not. All that is out of
    sight has one and the same body."""
    told = {"NOT_FOUND": "not found", "FORBIDDEN": "forbidden", "CONFLICT": "conflict", "REJECTED": "rejected"}
    body = F.lit(None).cast("string")
    for code, message in told.items():
        error = F.struct(F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")).alias("error"))
        body = F.when(outcome == code, F.to_json(error)).otherwise(body)
    return body


def review_report(findings: DataFrame, items: DataFrame, review: str) -> DataFrame:
    """Per review: coverage, counts by classification, alignment, and how many findings need a decision.

    findings: review, classification, requires_decision; items: review, items (requirements of its snapshot).
    """
    n = lambda c: F.count_if(F.col("classification") == c).cast("long")
    per = findings.groupBy(review).agg(
        F.count("*").alias("evaluated"), n("MATCH").alias("matched"), n("DEVIATION").alias("deviating"), n("MISSING").alias("missing"), n("CONFLICT").alias("conflicting"),
        F.count_if(F.col("classification").isin(*TIER_1)).cast("long").alias("fail_closed"), F.count_if("requires_decision").cast("long").alias("requiring_decision"),
    )
    rows = items.join(per, review, "left").na.fill(0, ["evaluated", "matched", "deviating", "missing", "conflicting", "fail_closed", "requiring_decision"])
    return rows.withColumn("unevaluated", F.col("items") - F.col("evaluated")).withColumn("alignment", F.bround(F.try_divide(F.col("matched").cast("double"), F.col("evaluated").cast("double")), 4))


def run_summary(outcomes: DataFrame, run: str) -> DataFrame:
    """Per run: findings created, requirements skipped as optional, failures, and the signals in order."""
    n = lambda c: F.count_if(F.col("outcome") == c).cast("long")
    return outcomes.groupBy(run).agg(n("FINDING").alias("findings_created"), n("OPTIONAL").alias("skipped_as_optional"), n("FAILURE").alias("failures"), F.array_join(F.sort_array(F.collect_set("signal")), ",").alias("signals"))


def difference(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """How two sets of rows differ: unexpected, absent, changed or same; null keys equal each other."""
    e = expected.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.struct(*values).alias("e"))
    a = actual.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.struct(*values).alias("a"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"e_{k}").eqNullSafe(F.col(f"a_{k}"))
    rows = e.join(a, on, "full_outer")
    verdict = F.when(F.col("e").isNull(), "unexpected").when(F.col("a").isNull(), "absent").when(F.col("e").eqNullSafe(F.col("a")), "same").otherwise("changed")
    return rows.select(*[F.coalesce(f"e_{k}", f"a_{k}").alias(k) for k in keys], verdict.alias("verdict"))


def difference_of(rows: DataFrame, side: str, keys: list[str], values: list[str]) -> DataFrame:
    """As difference(), of rows whose side is "expected" or "actual" and that each have a key once: one aggregate, no join."""
    of = lambda s, name: F.max(F.when(F.col(side) == s, F.struct(*values))).alias(name)
    per = rows.groupBy(*keys).agg(of("expected", "e"), of("actual", "a"))
    verdict = F.when(F.col("e").isNull(), "unexpected").when(F.col("a").isNull(), "absent").when(F.col("e").eqNullSafe(F.col("a")), "same").otherwise("changed")
    return per.select(*keys, verdict.alias("verdict"))
