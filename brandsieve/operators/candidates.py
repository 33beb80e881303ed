"""Typosquat candidates generated from the watchlist, and the ones that already have a certificate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandsieve.operators.watchlist import watchlist_terms

# --- fixed values -----------------------------------------------------------
CANDIDATE_MODIFIERS = ["login", "verifikasi", "verify", "resmi", "secure", "update"]
CANDIDATE_TLDS = ["xyz", "top"]
MIN_STEM = 4
# ----------------------------------------------------------------------------


def generate_candidates(watch: DataFrame) -> DataFrame:
    """Distinct hosts ``stem[-modifier].tld``; each stem grows by a fixed 7 x 2 array, not by a join."""
    stem = F.col("official_stem")
    names = F.array(stem, *[F.concat(stem, F.lit(f"-{m}")) for m in CANDIDATE_MODIFIERS])
    hosts = F.flatten(
        F.transform(names, lambda n: F.array(*[F.concat(n, F.lit(f".{t}")) for t in CANDIDATE_TLDS]))
    )
    return (
        watchlist_terms(watch)
        .where(F.length(stem) >= MIN_STEM)
        .select("official_stem")
        .distinct()
        .select("official_stem", F.explode(hosts).alias("host"))
        .select("host", "official_stem")
        .dropDuplicates(["host"])
    )


def candidates_with_certificate(candidates: DataFrame, certs: DataFrame) -> DataFrame:
    """Candidates having at least one certificate, with the earliest not_before.

    The candidate list is the small side, so the certificates are reduced by the join first
    and only hits are aggregated.
    """
    return (
        certs.select(F.col("domain").alias("host"), "not_before")
        .where(F.col("not_before").isNotNull())
        .join(candidates.select("host"), "host")
        .groupBy("host")
        .agg(F.min("not_before").alias("not_before"))
    )
