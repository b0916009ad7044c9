"""Settings of a deployment, read from the session's configuration under spark.lexmill."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexmill.functions.vocab import RATE_LIMITS

#: Names and defaults: seconds an analysis may take, bytes of an upload, rows of a page and the most that may be asked for, and
#: how many requests of a kind one key may make in how many seconds.
DEFAULTS = {"analysis.time_limit": 1800, "upload.max_bytes": 50 * 1024 * 1024, "page.size": 25, "page.largest": 100} | {
    f"rate.{kind.lower()}.{part}": RATE_LIMITS[kind][i] for kind in RATE_LIMITS for i, part in enumerate(("most", "seconds"))
}


def setting(spark: SparkSession, name: str) -> int:
    """The session's value of a setting, or its default; unknown names and values that are not positive are errors."""
    value = int(spark.conf.get(f"spark.lexmill.{name}", str(DEFAULTS[name])))
    if value <= 0:
        raise ValueError(f"{name} must be positive")
    return value
