"""The daily funnel: brand match, technical evidence, score, findings and daily counters.

One lazy plan. It runs for a single day (``S8`` slice, partition-pruned on a date-partitioned table)
or for all days at once; counters come from the same stage-tagged frame as the findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.functions import scoring
from brandsieve.functions.domains import is_risky_tld, last_label
from brandsieve.operators.brand_match import find_similar
from brandsieve.operators.enrich import with_blacklist, with_liveness, with_registration
from brandsieve.operators.upsert import upsert

# --- fixed values -----------------------------------------------------------
OLD_AGE_DAYS = 90
LOW_SIMILARITY = 0.80
# ----------------------------------------------------------------------------

UPSERT_COLUMNS = ["risk_score", "risk_level", "is_live", "last_status_code", "reasoning"]
COUNTERS = [
    "domains_scanned", "tahap1_passed", "tahap2_passed", "tahap3_assessed",
    "domains_flagged", "domains_live", "flagged_not_in_blacklist",
]
#: Columns of the findings table.
FINDINGS = (
    "domain string, first_seen timestamp, registered_at string, registrar string, nameservers string, matched_brand string, match_method string, "
    "risk_score int, risk_level string, is_live boolean, last_status_code int, reasoning string, "
    "in_public_blacklist_at_detection boolean, blacklist_checked_at timestamp"
)
SIGNALS = {"domain_age_days", "watchlist_matched", "is_risky_tld"}


def day_slice(ct_raw: DataFrame, day: str, limit: int | None = None) -> DataFrame:
    """Hosts first seen on one UTC day; a range on the timestamp, so Parquet statistics prune."""
    start = F.lit(day).cast("timestamp")
    rows = ct_raw.where((F.col("first_seen") >= start) & (F.col("first_seen") < start + F.expr("INTERVAL 1 DAY")))
    return rows.orderBy("first_seen", "domain").limit(limit) if limit is not None else rows


def brand_stage(ct_raw: DataFrame, watch: DataFrame) -> DataFrame:
    """Stage 1: hosts with a brand match, one row per cleaned host; of several spellings the first seen."""
    return find_similar(ct_raw, watch, carry=["first_seen", *[c for c in ct_raw.columns if c not in ("domain", "first_seen")]])


def technical_stage(stage1: DataFrame, rdap: DataFrame, blacklist: DataFrame, probes: DataFrame, now: Column) -> DataFrame:
    """Stage 2: evidence columns and the ``escalated`` flag (established dead hosts are not).

    The snapshots by host come first: the matches lie by host already and move but once, to their registrable domain.
    """
    rows = with_registration(with_liveness(with_blacklist(stage1, blacklist, now), probes), rdap, now)
    for c in ("registrar", "nameservers"):  # an answer without a date is no evidence
        rows = rows.withColumn(c, F.when(F.col("registration_date").isNotNull(), F.col(c)))
    rows = (
        rows.withColumnRenamed("registration_date", "registered_at")
        .withColumn("domain_age_days", scoring.domain_age_days(F.col("registered_at"), now))
        .withColumn("in_blacklist", F.col("blacklist_status") == "listed")
    )
    dead = ~F.col("is_live") & (F.col("domain_age_days") > OLD_AGE_DAYS) & (F.col("similarity_score") < LOW_SIMILARITY)
    return rows.withColumn("escalated", ~F.coalesce(dead, F.lit(False)))


def scoring_stage(stage2: DataFrame) -> DataFrame:
    """Stage 3: score, level, reasoning and the flag."""
    rows = (
        stage2.withColumn("watchlist_matched", F.lit(True))
        .withColumn("is_risky_tld", is_risky_tld(F.col("domain")))
        .withColumn("tld", last_label(F.col("domain")))
    )
    listed = F.when(F.col("in_blacklist"), scoring.BLACKLIST_POINTS).otherwise(0)
    rows = rows.withColumn("risk_score", F.least(F.lit(100), scoring.risk_score(SIGNALS) + listed))
    parts = F.concat(
        scoring.reasons(SIGNALS, set(rows.columns)),
        F.array_compact(
            F.array(
                F.when(F.col("is_live"), F.lit("The domain answers (live).")),
                F.when(F.col("in_blacklist"), F.lit("Listed on the public blacklist.")),
            )
        ),
    )
    return (
        rows.withColumn("risk_level", scoring.risk_level(F.col("risk_score")))
        .withColumn("reasoning", F.array_join(parts, " "))
        .withColumn("flagged", F.col("escalated") & (F.col("risk_score") >= scoring.FLAG_MIN))
    )


def run_funnel(
    ct_raw: DataFrame, watch: DataFrame, rdap: DataFrame, blacklist: DataFrame, probes: DataFrame, now: Column
) -> DataFrame:
    """Stage-tagged rows of all brand matches: ``escalated`` and ``flagged`` tell how far each went."""
    return scoring_stage(technical_stage(brand_stage(ct_raw, watch), rdap, blacklist, probes, now))


def findings(tagged: DataFrame, checked_at: Column) -> DataFrame:
    """Rows for the findings table."""
    return tagged.where("flagged").select(
        "domain",
        F.coalesce("not_before", "first_seen").alias("first_seen"),
        "registered_at", "registrar", "nameservers", "matched_brand", "match_method", "risk_score", "risk_level",
        "is_live", "last_status_code", "reasoning",
        F.col("in_blacklist").alias("in_public_blacklist_at_detection"),
        checked_at.alias("blacklist_checked_at"),
    )


def day_counters(ct_raw: DataFrame, tagged: DataFrame) -> DataFrame:
    """Funnel counters per UTC day of first sight; a day with no match still has its row."""
    scanned = ct_raw.groupBy(F.to_date("first_seen").alias("date")).agg(F.count("*").alias("domains_scanned"))
    stages = tagged.groupBy(F.to_date("first_seen").alias("date")).agg(
        F.count("*").alias("tahap1_passed"),
        F.count_if("escalated").alias("tahap2_passed"),
        F.count_if("escalated").alias("tahap3_assessed"),
        F.count_if("flagged").alias("domains_flagged"),
        F.count_if(F.col("flagged") & F.col("is_live")).alias("domains_live"),
        F.count_if(F.col("flagged") & ~F.col("in_blacklist")).alias("flagged_not_in_blacklist"),
    )
    return scanned.join(stages, "date", "left").fillna(0, COUNTERS).select("date", *COUNTERS)


def counters_of_day(counters: DataFrame, day: str) -> DataFrame:
    """Exactly one row for ``day``, zeros included: an empty day is a result, not a gap."""
    spark = counters.sparkSession
    one = spark.range(1).select(F.lit(day).cast("date").alias("date"))
    return one.join(counters, "date", "left").fillna(0, COUNTERS)


def upsert_findings(existing: DataFrame, found: DataFrame) -> DataFrame:
    """The findings table after a run: known hosts get the five columns of the new look, the rest is new."""
    return upsert(existing, found, ["domain"], UPSERT_COLUMNS)


def upsert_daily(existing: DataFrame, counters: DataFrame) -> DataFrame:
    """The daily table after a run: the counters of the day replace, other columns keep their first value."""
    return upsert(existing, counters, ["date"], COUNTERS)


def ratio_text() -> Column:
    """One-line summary of a counters row."""
    n = lambda c: F.format_number(F.col(c), 0)
    return F.concat(
        n("domains_scanned"), F.lit(" (scanned) -> "), n("tahap1_passed"), F.lit(" (brand match) -> "),
        n("tahap2_passed"), F.lit(" (technical) -> "), n("tahap3_assessed"), F.lit(" (assessed) -> "),
        n("domains_flagged"), F.lit(" flagged findings"),
    )


def rescore_backlog(ct_raw: DataFrame, watch: DataFrame, blacklist: DataFrame, now: Column) -> DataFrame:
    """Unprocessed hosts scored by the deprecated backlog rule."""
    backlog = ct_raw.where(F.col("processed_at").isNull())
    rows = with_blacklist(brand_stage(backlog, watch), blacklist, now)
    score = scoring.backlog_score(F.col("similarity_score"), is_risky_tld(F.col("domain")))
    return rows.withColumn("risk_score", score).select(
        "domain",
        F.coalesce("not_before", "first_seen").alias("first_seen"),
        "matched_brand", "match_method", "risk_score",
        F.when(F.col("risk_score") >= scoring.FRAUD_MIN, scoring.FRAUD).otherwise(scoring.CAUTION).alias("risk_level"),
        (F.col("blacklist_status") == "listed").alias("in_public_blacklist_at_detection"),
    )
