"""Session defaults for jobs and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


# Settings that hold for every job.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC, adaptive execution and skew handling; sizing is left to the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
