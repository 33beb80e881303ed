"""Operational health from the run log and the daily stats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
MAX_STALENESS_HOURS = 26.0
DAY_DONE_AT = "INTERVAL '23:45' HOUR TO MINUTE"
# ----------------------------------------------------------------------------


def _hours(now: Column, then: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(3_600_000_000)


def check_health(runs: DataFrame, daily: DataFrame, now: Column, max_hours: float = MAX_STALENESS_HOURS) -> DataFrame:
    """One row: latest run, hours since the last good one, latest day and the list of issues."""
    at = F.coalesce("finished_at", "started_at")
    r = runs.agg(
        F.max_by("status", "id").alias("latest_collector_status"),
        F.max_by(at, "id").alias("latest_collector_time"),
        F.max(F.when(F.col("status") == "ok", at)).alias("last_successful_collector_time"),
    )
    d = daily.agg(F.max("date").alias("latest_heartbeat_date"), F.max_by("heartbeat_ok", "date").alias("latest_heartbeat_ok"))
    stale = _hours(now, F.col("last_successful_collector_time"))
    day_age = _hours(now, F.to_timestamp("latest_heartbeat_date") + F.expr(DAY_DONE_AT))
    status = F.col("latest_collector_status")
    issues = F.array_compact(
        F.array(
            F.when(status.isNull(), "no_runs"),
            F.when(status != "ok", F.concat(F.lit("latest_run_"), status)),
            F.when(status.isNotNull() & F.col("last_successful_collector_time").isNull(), "no_successful_run"),
            F.when(stale > max_hours, "collector_stale"),
            F.when(F.col("latest_heartbeat_date").isNull(), "no_daily_stats"),
            F.when(~F.col("latest_heartbeat_ok"), "heartbeat_failed"),
            F.when(day_age > max_hours, "daily_stats_stale"),
        )
    )
    return (
        r.crossJoin(d)  # two one-row frames
        .withColumn("staleness_hours", F.bround(stale, 1))
        .withColumn("issues", issues)
        .withColumn("is_healthy", F.size("issues") == 0)
    )
