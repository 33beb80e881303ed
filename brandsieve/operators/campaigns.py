"""Campaign clustering: shared name servers first, then brand and method within a time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.functions.domains import nameserver_signature, strip
from brandsieve.functions.messages import evaluated_once
from brandsieve.operators.running import running_sum
from brandsieve.operators.upsert import upsert

# --- fixed values -----------------------------------------------------------
MIN_NAMESERVER_CLUSTER = 2
MIN_BRAND_CLUSTER = 3
WINDOW_DAYS = 7
# ----------------------------------------------------------------------------
SLICE_US = 600_000_000  # ten minutes: the unit in which a hot key is spread


def nameserver_clusters(findings: DataFrame) -> DataFrame:
    """(cluster_key, member_count) for signatures shared by two findings or more. Counts only: no group is collected."""
    return (
        evaluated_once(findings, "cluster_key", nameserver_signature(F.col("nameservers")))
        .where(F.col("cluster_key").isNotNull())
        .groupBy("cluster_key")
        .agg(F.count("*").alias("member_count"))
        .where(F.col("member_count") >= MIN_NAMESERVER_CLUSTER)
    )


def largest_windows(rows: DataFrame, keys: list[str], days: int = WINDOW_DAYS, ts: str = "first_seen") -> DataFrame:
    """Per key the largest set of rows whose time span is at most ``days`` whole days; earliest on ties.

    Output: keys, window_start_us, window_end_us, member_count. A window ends at one of its rows and
    reaches back ``(days + 1)`` days less a microsecond.

    One key may own a third of all rows, so the count is a running sum over slices of time: every
    row enters at its time and leaves one span later.
    """
    span = (days + 1) * 86_400_000_000
    points = (
        rows.where(F.col(ts).isNotNull())
        .groupBy(*keys, F.unix_micros(F.col(ts)).alias("us"))  # equal times are peers: one point with a weight
        .agg(F.count("*").alias("n"))
    )
    # at equal times leaving comes first: a row one whole span later must not count
    enters = points.select(*keys, "us", F.lit(1).alias("kind"), F.col("n").alias("delta"))
    leaves = points.select(*keys, (F.col("us") + span).alias("us"), F.lit(0).alias("kind"), (-F.col("n")).alias("delta"))
    slices = F.floor(F.col("us") / F.lit(SLICE_US)).cast("long")
    counted = running_sum(
        enters.unionByName(leaves), keys, slices, ["us", "kind"], F.col("delta"), "members"
    ).where(F.col("kind") == 1)
    best = counted.groupBy(*keys).agg(F.max(F.struct("members", (-F.col("us")).alias("neg_us"))).alias("b"))
    return best.select(
        *keys,
        (-F.col("b.neg_us") - (span - 1)).alias("window_start_us"),
        (-F.col("b.neg_us")).alias("window_end_us"),
        F.col("b.members").alias("member_count"),
    )


def label_findings(findings: DataFrame) -> DataFrame:
    """Every finding with cluster_type and cluster_key (null when in no cluster).

    Recomputed from scratch: a finding in a name-server cluster is never considered for a brand cluster.
    Cluster tables hold one row per cluster and are joined without a hint: small ones are broadcast by
    their measured size, and in a shuffle the hot key of one large cluster is split by skew handling.
    """
    by_ns = nameserver_clusters(findings).select(F.col("cluster_key").alias("_sig"), F.lit(True).alias("_in_ns"))
    rows = (
        evaluated_once(findings, "_sig", nameserver_signature(F.col("nameservers")))
        .withColumn("_brand", F.when(F.col("matched_brand") != "", F.lower(strip(F.col("matched_brand")))))
        .withColumn("_method", F.lower(strip(F.coalesce("match_method", F.lit("")))))
    )
    # rows without a signature, and those without a brand, have nothing to look up and skip the joins
    signed = rows.where(F.col("_sig").isNotNull()).join(by_ns, "_sig", "left")
    unsigned = rows.where(F.col("_sig").isNull()).withColumn("_in_ns", F.lit(None).cast("boolean"))
    rows = signed.unionByName(unsigned)
    free = F.col("_in_ns").isNull() & F.col("_brand").isNotNull()
    loose = rows.where(free)
    by_brand = (
        largest_windows(loose.select("_brand", "_method", "first_seen"), ["_brand", "_method"])
        .where(F.col("member_count") >= MIN_BRAND_CLUSTER)
        .select("_brand", "_method", "window_start_us", "window_end_us")
    )
    inside = F.unix_micros("first_seen").between(F.col("window_start_us"), F.col("window_end_us"))
    by_window = loose.join(by_brand, ["_brand", "_method"], "left").select(
        *findings.columns,
        F.when(inside, "brand_pattern").alias("cluster_type"),
        F.when(inside, F.concat_ws("|", "_brand", "_method")).alias("cluster_key"),
    )
    others = rows.where(~free).select(
        *findings.columns,
        F.when(F.col("_in_ns"), "nameserver").alias("cluster_type"),
        F.when(F.col("_in_ns"), F.col("_sig")).alias("cluster_key"),
    )
    return others.unionByName(by_window)


def campaigns(labelled: DataFrame, now: Column) -> DataFrame:
    """Campaign rows; the id is a stable hash of type and key."""
    return (
        labelled.where(F.col("cluster_type").isNotNull())
        .groupBy("cluster_type", "cluster_key")
        .agg(F.count("*").alias("member_count"))
        .withColumn("id", F.xxhash64("cluster_type", "cluster_key"))
        .withColumn("first_detected_at", now)
        .withColumn("last_updated_at", now)
    )


def upsert_campaigns(existing: DataFrame, current: DataFrame) -> DataFrame:
    return upsert(existing, current, ["cluster_type", "cluster_key"], ["member_count", "last_updated_at"])


def summary(labelled: DataFrame) -> DataFrame:
    """Clusters and labelled findings per cluster type."""
    return (
        labelled.where(F.col("cluster_type").isNotNull())
        .groupBy("cluster_type", "cluster_key")
        .agg(F.count("*").alias("n"))
        .groupBy("cluster_type")
        .agg(F.count("*").alias("clusters"), F.sum("n").alias("domains_labeled"))
    )
