"""Write semantics as joins: each function returns the table's new content, to be written as a new version.

Plain Parquet has no MERGE; a table format that has one can run the same rules in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-replace: the newest row per key. The maximum combines map-side, so no hot key.

    ``order`` is shuffled once, in front of the other columns; only columns that have no order of their own stand behind it twice.
    """
    rest = [c for c in log.columns if c not in keys]
    if any(kind in log.schema[c].dataType.simpleString() for c in rest for kind in ("map<", "variant")):
        newest = F.max_by(F.struct(*rest), F.struct(*order))
    else:
        newest = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    return log.groupBy(*keys).agg(newest.alias("v")).select(*keys, *[F.col("v")[c].alias(c) for c in rest])


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows to append: first writer wins. ``incoming`` must be unique on ``key``."""
    return incoming.join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], replace: list[str]) -> DataFrame:
    """On conflict replace only ``replace``; every other column keeps its first value."""
    old, new = existing.withColumn("_old", F.lit(True)).alias("o"), incoming.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, keys, "full_outer")

    def pick(c: str) -> Column:
        o = F.col(f"o.{c}") if c in existing.columns else F.lit(None)
        n = F.col(f"n.{c}") if c in incoming.columns else F.lit(None)
        if c in replace:
            return F.when(F.col("_new").isNotNull(), n).otherwise(o).alias(c)
        return F.when(F.col("_old").isNotNull(), o).otherwise(n).alias(c)

    columns = existing.columns + [c for c in incoming.columns if c not in existing.columns]
    return joined.select(*[F.col(c) if c in keys else pick(c) for c in columns])


def mark(existing: DataFrame, done: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """Set ``column`` to ``value`` where the key is in ``done``; rows already marked keep their mark."""
    flagged = existing.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    return flagged.withColumn(
        column, F.when(F.col("_done"), F.coalesce(F.col(column), value)).otherwise(F.col(column))
    ).drop("_done")


def add_usage(calls: DataFrame) -> DataFrame:
    """Additive upsert as a sum over the append-only call log."""
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return calls.groupBy("date").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(total).alias("total_tokens"),
        F.count("*").alias("call_count"),
    )


def within_retention(rows: DataFrame, now: Column, days: int, column: str = "received_at") -> DataFrame:
    """Rows kept by a retention run: everything not strictly older than the cutoff."""
    return rows.where(F.col(column) >= now - F.expr(f"INTERVAL {days} DAYS"))


def purged_count(rows: DataFrame, now: Column, days: int, column: str = "received_at") -> DataFrame:
    return rows.agg(F.count_if(F.col(column) < now - F.expr(f"INTERVAL {days} DAYS")).alias("purged"))
