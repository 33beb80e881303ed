"""Enrichment joins: registration, blacklist and liveness snapshots, with freshness rules.

None of the snapshots is broadcast by hint: they grow with the data, and Spark's own size check
decides. Missing or stale evidence is never read as a clean result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.functions.domains import clean_domain, last_label, registrable_domain
from brandsieve.operators.upsert import latest_per_key
from brandsieve.sources.snapshots import DEFAULT_RDAP_URL

# --- fixed values -----------------------------------------------------------
TTL_FOUND = "INTERVAL 7 DAYS"
TTL_NOT_FOUND = "INTERVAL 24 HOURS"
TTL_BOOTSTRAP = "INTERVAL 30 DAYS"
TTL_LISTED = "INTERVAL 12 HOURS"
TTL_NOT_LISTED = "INTERVAL 6 HOURS"
LIVE_BELOW = 400
# ----------------------------------------------------------------------------


def with_registration(hosts: DataFrame, rdap: DataFrame, now: Column) -> DataFrame:
    """Left join on the registrable domain; a stale or not-found answer gives nulls.

    ``rdap``: one row per domain with registration_date, registrar, nameservers, is_not_found, fetched_at.
    """
    fresh = F.col("fetched_at") > now - F.expr(TTL_FOUND)
    answers = rdap.where(~F.col("is_not_found")).select(
        F.col("domain").alias("_reg"), "registration_date", "registrar", "nameservers", "fetched_at"
    )
    joined = hosts.withColumn("_reg", registrable_domain(F.col("domain"))).join(answers, "_reg", "left")
    for c in ("registration_date", "registrar", "nameservers"):
        joined = joined.withColumn(c, F.when(fresh, F.col(c)))
    return joined.drop("_reg", "fetched_at")


def registration_requests(hosts: DataFrame, rdap: DataFrame, bootstrap: DataFrame, now: Column) -> DataFrame:
    """Registrable domains without a fresh answer, found or not, with the endpoint to ask."""
    ttl = F.when(F.col("is_not_found"), F.expr(TTL_NOT_FOUND)).otherwise(F.expr(TTL_FOUND))
    fresh = rdap.where(F.col("fetched_at") > now - ttl).select(F.col("domain").alias("reg"))
    known = bootstrap.where(F.col("fetched_at") > now - F.expr(TTL_BOOTSTRAP)).select("tld", "rdap_url")
    return (
        hosts.select(registrable_domain(F.col("domain")).alias("reg"))
        .where(F.col("reg").isNotNull())
        .distinct()
        .join(fresh, "reg", "left_anti")
        .withColumn("tld", last_label(F.col("reg")))
        .join(known, "tld", "left")
        .select("reg", F.concat(F.coalesce("rdap_url", F.lit(DEFAULT_RDAP_URL)), F.lit("domain/"), "reg").alias("url"))
    )


def with_blacklist(hosts: DataFrame, blacklist: DataFrame, now: Column) -> DataFrame:
    """blacklist_status per host; stale or absent answers are ``unknown``."""
    ttl = F.when(F.col("status") == "listed", F.expr(TTL_LISTED)).otherwise(F.expr(TTL_NOT_LISTED))
    # what says no more than an absent answer need not travel to the hosts
    telling = (F.col("checked_at") > now - ttl) & ~F.col("status").eqNullSafe(F.lit("unknown"))
    answers = blacklist.where(telling).select(clean_domain(F.col("domain")).alias("domain"), "status", F.lit(True).alias("_met"))
    return (
        hosts.join(answers, "domain", "left")
        .withColumn("blacklist_status", F.when(F.col("_met"), F.col("status")).otherwise("unknown"))
        .drop("status", "_met")
    )


def maybe_listed(log: DataFrame, now: Column) -> DataFrame:
    """Looks at the blacklist that are not older than any answer may be; a host with none of them is ``unknown`` either way."""
    return log.where(F.col("checked_at") > now - F.expr(TTL_LISTED))


def with_liveness(hosts: DataFrame, probes: DataFrame) -> DataFrame:
    """last_status_code and is_live; a host never probed is not live."""
    return hosts.join(
        probes.select("domain", F.col("status_code").alias("last_status_code")), "domain", "left"
    ).withColumn("is_live", F.coalesce(F.col("last_status_code") < LIVE_BELOW, F.lit(False)))


def stale_negative_entries(rdap: DataFrame) -> DataFrame:
    """Not-found entries filed under a sub-domain; to be purged."""
    return rdap.where(F.col("is_not_found") & (F.col("domain") != registrable_domain(F.col("domain"))))


def latest(log: DataFrame, order: list[str]) -> DataFrame:
    return latest_per_key(log, ["domain"], order)
