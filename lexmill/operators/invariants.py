"""Checks that hold before anything is written. Each gives the offending rows; none may be left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.evaluate import evidence_violation


def without_evaluation(findings: DataFrame, evaluations: DataFrame, key: str) -> DataFrame:
    """Findings without any evaluation."""
    return findings.join(evaluations.select(key), key, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def lacking_evidence(evaluations: DataFrame) -> DataFrame:
    return evaluations.filter(evidence_violation(F.col("classification"), F.col("evidence")))


def foreign_decisions(decisions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Decisions whose evaluation does not belong to the finding they name."""
    return decisions.join(evaluations.select("finding_id", "evaluation_id"), ["finding_id", "evaluation_id"], "left_anti")


def nulls(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNull())


def outside(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not one of a closed set; null is outside."""
    return rows.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def dangling(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows that point at nothing."""
    return rows.filter(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)), column, "left_anti")


def unpaired(findings: DataFrame, evaluations: DataFrame, key: str) -> dict[str, DataFrame]:
    """without_evaluation(), duplicates() and dangling() at once, by name: the keys of both sides meet in one aggregate, whose
    only row is read here. Each of the results has one row or none."""
    side = lambda rows, f, e: rows.select(F.col(key).alias("key"), F.lit(f).alias("f"), F.lit(e).alias("e"))
    per = side(findings, 1, 0).unionAll(side(evaluations, 0, 1)).groupBy("key").agg(F.sum("f").alias("f"), F.sum("e").alias("e"))
    f, e, known = F.col("f") > 0, F.col("e") > 0, F.col("key").isNotNull()
    broken = {"finding_without_evaluation": f & ~(e & known), "duplicate_finding": F.col("f") > 1, "evaluation_without_finding": e & ~f & known}
    got = per.agg(*[F.count_if(c).alias(n) for n, c in broken.items()]).first()
    some = findings.sparkSession.range(1)
    return {n: some.filter(F.lit(got[n] > 0)) for n in broken}


class InvariantBroken(ValueError):
    pass


def require_empty(**checks: DataFrame) -> None:
    """Refuse to go on while any check has a row; at most one row of each is read."""
    broken = [name for name, df in checks.items() if not df.isEmpty()]
    if broken:
        raise InvariantBroken(", ".join(sorted(broken)))
