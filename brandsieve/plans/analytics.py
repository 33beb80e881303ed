"""Report aggregates over findings, daily stats, runs, messages and campaigns.

Small answers from big tables: everything aggregates map-side first, totals come from the grouped
rows, and top-k lists are ``orderBy().limit()`` (TakeOrderedAndProject) with a stable last key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandsieve.functions import scoring
from brandsieve.functions.domains import mask_domain, report_tld
from brandsieve.operators.categories import severity
from brandsieve.operators.running import running_sum

# --- fixed values -----------------------------------------------------------
TACTICS = {"typo": "edit_distance", "keyword": "keyword", "homoglyph": "homoglyph", "subdomain": "permutation"}
SECTORS = [
    ("Banking, Fintech & P2P", ["bca", "mandiri", "bri", "bni", "cimb", "dana", "ovo", "gopay", "linkaja", "seabank", "jago", "investree",
                                "kredivo", "finmas", "superbank", "nagari", "kalteng", "jatim", "jenius", "pegadaian", "pluang"]),
    ("Logistics & Delivery", ["pos", "jne", "j&t", "sicepat", "tiki", "anteraja", "paxel"]),
    ("E-Commerce & Travel", ["shopee", "tokopedia", "lazada", "blibli", "tiktok", "bukalapak", "tiket"]),
    ("EdTech & Education", ["ruangguru", "zenius", "pahamify"]),
    ("State-Owned Enterprises & Public Institutions", ["pajak", "bansos", "bpjs", "pln", "telkom", "kemenag", "kominfo", "pandi",
                                                        "pertamina", "kepolisian"]),
]
OTHER_SECTOR = "Other Commercial Brands"
REGIONS = ["DKI Jakarta", "Jawa Barat", "Jawa Timur", "Jawa Tengah", "Sumatera Utara", "Other"]
REGION_WEIGHTS = {
    "Shopee Indonesia": [0.22, 0.20, 0.16, 0.14, 0.10, 0.18],
    "Ruangguru": [0.18, 0.24, 0.18, 0.16, 0.08, 0.16],
    "GoPay Indonesia": [0.26, 0.19, 0.15, 0.12, 0.11, 0.17],
    "Paxel Indonesia": [0.24, 0.21, 0.17, 0.11, 0.09, 0.18],
    "Investree Indonesia": [0.30, 0.17, 0.13, 0.10, 0.10, 0.20],
    "Pos Indonesia": [0.15, 0.18, 0.17, 0.16, 0.13, 0.21],
}
DEFAULT_WEIGHTS = [0.20, 0.19, 0.16, 0.14, 0.11, 0.20]
REPORT_ZONE = "Asia/Jakarta"
DAILY_TOKEN_LIMIT = 100_000
# ----------------------------------------------------------------------------
CALL_SLICE = 10_000


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.bround(part / whole * 100, digits)).otherwise(0.0)


def _total(n: str = "count") -> Column:
    # over grouped rows only, of which there are few
    return F.sum(n).over(Window.partitionBy())


def latest_day(daily: DataFrame) -> DataFrame:
    """Newest daily row with zeros for missing counters."""
    cols = [c for c in daily.columns if c != "date"]
    newest = daily.agg(F.max_by(F.struct("date", *cols), "date").alias("d")).select("d.*")
    return newest.fillna(0).fillna(False)


def trend(daily: DataFrame, days: int = 14) -> DataFrame:
    return daily.orderBy(F.desc("date")).limit(days).orderBy("date")


def day_over_day(daily: DataFrame, value: str = "domains_scanned") -> DataFrame:
    """Absolute change against the row before; one row per day, so the single window partition is small."""
    w = Window.partitionBy().orderBy("date")
    return daily.select("date", value, (F.col(value) - F.lag(value).over(w)).alias("delta"))


def trailing_week(daily: DataFrame) -> DataFrame:
    """Mean flagged over the seven days before, null below three rows, and the change in percent."""
    day = F.unix_date(F.to_date("date"))
    w = Window.partitionBy().orderBy("_d").rangeBetween(-7, -1)
    rows = daily.withColumn("_d", day).select(
        "date", "domains_flagged", F.count("*").over(w).alias("days"), F.sum("domains_flagged").over(w).alias("_s")
    )
    mean = F.when(F.col("days") >= 3, F.col("_s") / F.col("days"))
    return rows.withColumn("avg_flagged", mean).select(
        "date", "domains_flagged", "days", "avg_flagged",
        F.when(F.col("avg_flagged") > 0, (F.col("domains_flagged") - F.col("avg_flagged")) / F.col("avg_flagged") * 100).alias("pct_change"),
        F.when(F.col("avg_flagged").isNull(), "too_little_history")
        .when(F.col("avg_flagged") == 0, F.when(F.col("domains_flagged") == 0, "stable").otherwise("new"))
        .when(F.col("domains_flagged") > F.col("avg_flagged"), "up")
        .when(F.col("domains_flagged") < F.col("avg_flagged"), "down")
        .otherwise("stable")
        .alias("direction"),
    )


def tld_distribution(findings: DataFrame, top: int = 7) -> DataFrame:
    return (
        findings.groupBy(report_tld(F.col("domain")).alias("tld"))
        .agg(F.count("*").alias("count"))
        .withColumn("pct", pct(F.col("count"), _total()))
        .withColumn("is_cctld", F.col("tld").endswith(".id"))
        .orderBy(F.desc("count"), "tld")
        .limit(top)
    )


def tactic_distribution(findings: DataFrame) -> DataFrame:
    """The four tactics, zero counts included; the share is of all findings."""
    counts = findings.groupBy(F.coalesce(F.when(F.col("match_method") != "", F.col("match_method")), F.lit("edit_distance")).alias("method")).agg(
        F.count("*").alias("count")
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).alias("method")) for k, v in TACTICS.items()])
    # one row with everything counted, then four rows out of it; only the tactics' own methods are gathered
    known = F.when(F.col("method").isin(list(TACTICS.values())), F.struct("method", "count"))
    one = counts.agg(F.sum("count").alias("total"), F.map_from_entries(F.collect_list(known)).alias("by"))
    c = F.coalesce(F.try_element_at("by", F.col("t.method")), F.lit(0))
    return one.select("total", "by", F.explode(pairs).alias("t")).select(
        F.col("t.id").alias("id"), c.alias("count"), pct(c, F.coalesce("total", F.lit(0))).alias("pct")
    )


def hourly_velocity(findings: DataFrame) -> DataFrame:
    """24 hours of the latest local day with a finding, and which one peaks (the first of equals)."""
    local = F.from_utc_timestamp("first_seen", REPORT_ZONE)
    per_hour = findings.where(F.col("first_seen").isNotNull()).groupBy(F.to_date(local).alias("day"), F.hour(local).alias("hour")).agg(
        F.count("*").alias("count")
    )
    per_day = per_hour.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("hour", "count"))).alias("h"))
    latest = per_day.agg(F.max_by("h", "day").alias("h"))
    rows = latest.select("h", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")).select(
        "hour", F.coalesce(F.try_element_at("h", F.col("hour")), F.lit(0)).alias("count")
    )
    first = F.row_number().over(Window.partitionBy().orderBy(F.desc("count"), "hour"))
    return rows.withColumn("is_peak", first == 1)


def sector(brand: Column) -> Column:
    low = F.lower(F.coalesce(brand, F.lit("")))
    out = None
    for name, words in SECTORS:
        hit = low.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER_SECTOR)


def sector_breakdown(findings: DataFrame) -> DataFrame:
    per_brand = findings.groupBy("matched_brand").agg(F.count("*").alias("n"))  # the pattern runs once per brand
    return (
        per_brand.groupBy(sector(F.col("matched_brand")).alias("sector"))
        .agg(F.sum("n").alias("count"))
        .withColumn("pct", pct(F.col("count"), _total()))
    )


def level_counts(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("risk_level") == scoring.FRAUD).alias("fraud"),
        F.count_if(F.col("risk_level") == scoring.CAUTION).alias("caution"),
        F.count_if(F.col("risk_level") == scoring.SAFE).alias("safe"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def avg_lead_time_hours(findings: DataFrame) -> DataFrame:
    us = F.unix_micros("blacklist_listed_at") - F.unix_micros("first_seen")
    lead = F.when(us >= 0, us)
    hours = F.try_divide(F.sum(lead), F.count(lead) * F.lit(3_600_000_000))
    return findings.agg(F.bround(hours, 1).alias("avg_lead_time_hours"))


def top_brands(findings: DataFrame, top: int = 10) -> DataFrame:
    return (
        findings.where(F.col("matched_brand").isNotNull() & (F.col("matched_brand") != ""))
        .groupBy("matched_brand")
        .agg(
            F.count("*").alias("count"),
            F.max("risk_score").alias("max_score"),
            F.bround(F.avg("risk_score"), 1).alias("avg_score"),
        )
        .orderBy(F.desc("count"), "matched_brand")
        .limit(top)
    )


def category_totals(category_findings: DataFrame) -> DataFrame:
    return category_findings.groupBy("category").agg(
        F.count("*").alias("total"),
        F.count_if("is_hijacked_institution").alias("hijacked"),
        F.min("first_seen").alias("earliest_first_seen"),
    )


def collector_uptime(runs: DataFrame) -> DataFrame:
    ok, n = F.count_if(F.col("status") == "ok"), F.count("*")
    return runs.agg(n.alias("total_runs"), ok.alias("ok_runs")).withColumn(
        "uptime_pct", F.when(F.col("total_runs") > 0, F.bround(F.col("ok_runs") / F.col("total_runs") * 100, 2)).otherwise(100.0)
    )


def lifetime_totals(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.coalesce(F.max("peak_ram_mb"), F.lit(0)).alias("peak_ram_mb"),
        F.coalesce(F.sum("domains_scanned"), F.lit(0)).alias("total_scanned"),
        F.coalesce(F.sum("domains_flagged"), F.lit(0)).alias("total_flagged"),
    )


def largest_campaign(labelled: DataFrame, cluster_type: str) -> DataFrame:
    """The campaign of one type with the most members: members, live, blacklisted, first sight."""
    return (
        labelled.where(F.col("cluster_type") == cluster_type)
        .groupBy("cluster_key")
        .agg(
            F.count("*").alias("total_domains"),
            F.count_if("is_live").alias("domains_still_live"),
            F.count_if("in_public_blacklist_at_detection").alias("domains_now_in_blacklist"),
            F.min("first_seen").alias("first_detected_at"),
            F.min_by("matched_brand", F.struct("first_seen", "id")).alias("target_brand"),
        )
        .where(F.col("total_domains") >= 2)
        .orderBy(F.desc("total_domains"), "cluster_key")
        .limit(1)
    )


def campaign_timeline(labelled: DataFrame, campaign: DataFrame) -> DataFrame:
    """New hosts per day of the one given campaign; ``campaign`` is a single row."""
    return (
        labelled.join(F.broadcast(campaign.select("cluster_key").limit(1)), "cluster_key")
        .groupBy(F.to_date("first_seen").alias("date"))
        .agg(F.count("*").alias("count"))
    )


def regional_exposure(findings: DataFrame) -> DataFrame:
    """Brand counts spread over regions by weight. Brands are counted first, so weights meet few rows."""
    per_brand = findings.where(F.col("matched_brand").isNotNull()).groupBy("matched_brand").agg(F.count("*").alias("c"))

    def weights(values: list[float]) -> Column:
        return F.array(*[F.struct(F.lit(r).alias("region"), F.lit(w).alias("w")) for r, w in zip(REGIONS, values)])

    per = None
    for brand, values in REGION_WEIGHTS.items():
        cond = F.col("matched_brand") == brand
        per = F.when(cond, weights(values)) if per is None else per.when(cond, weights(values))
    totals = (
        per_brand.select("c", F.inline(per.otherwise(weights(DEFAULT_WEIGHTS))))
        .groupBy("region")
        # hundredths stay exact, so the sum does not depend on the order of rows
        .agg(F.sum(F.col("c") * F.round(F.col("w") * 100).cast("long")).alias("cents"))
    )
    top = F.max("cents").over(Window.partitionBy())
    return totals.select(
        "region",
        F.bround(F.col("cents") / 100).cast("long").alias("estimated_count"),
        F.bround(F.col("cents") / top * 100).cast("long").alias("intensity_pct"),
    )


def message_activity(messages: DataFrame) -> DataFrame:
    """Totals, counts per level and counts per day in one pass (grouping sets)."""
    return (
        messages.withColumn("day", F.date_format("received_at", "yyyy-MM-dd"))
        .groupingSets([["risk_level"], ["day"], []], "risk_level", "day")
        .agg(
            F.count("*").alias("count"),
            F.bround(F.avg("latency_ms")).cast("long").alias("avg_latency_ms"),
            F.count_if("report_drafted").alias("reports_drafted"),
        )
    )


def intake_per_day(ct_raw: DataFrame, source: str = "ctlogs_id") -> DataFrame:
    return ct_raw.groupBy(F.date_format("first_seen", "yyyy-MM-dd").alias("date_seen")).agg(
        F.count("*").alias("total_domains"),
        F.countDistinct("domain").alias("unique_domains"),
        F.count_if(F.col("source") == source).alias("source_count"),
    )


def runs_by_status(runs: DataFrame) -> DataFrame:
    s = F.col("status")
    return runs.agg(
        F.count("*").alias("total"),
        F.count_if(s == "ok").alias("ok_runs"),
        F.count_if(s == "partial").alias("partial_runs"),
        F.count_if(s == "failed").alias("failed_runs"),
    )


def last_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def findings_by_level(findings: DataFrame) -> DataFrame:
    return findings.groupBy("risk_level").agg(
        F.count("*").alias("count"),
        F.bround(F.avg("risk_score"), 1).alias("avg_score"),
        F.count_if("is_live").alias("live_count"),
        F.count_if("in_public_blacklist_at_detection").alias("in_blacklist_at_detection"),
    )


def stream_share(n_hosts: DataFrame, n_findings: DataFrame, messages: DataFrame) -> DataFrame:
    """Share and flag rate of the two intake streams, from one-row counts."""
    one = (
        n_hosts.agg(F.count("*").alias("scanned"))
        .crossJoin(n_findings.agg(F.count("*").alias("flagged")))
        .crossJoin(level_counts(messages).select(F.col("total").alias("analyzed"), "fraud"))
    )
    total = F.col("scanned") + F.col("analyzed")
    share = F.when(total > 0, F.round(F.col("scanned") / total * 100)).otherwise(0).cast("int")
    return one.select(
        share.alias("ct_share_pct"),
        F.when(total > 0, 100 - share).otherwise(0).alias("message_share_pct"),
        F.when(F.col("scanned") > 0, F.round(F.col("flagged") / F.col("scanned") * 100, 2)).otherwise(0.0).alias("ct_flag_rate"),
        F.when(F.col("analyzed") > 0, F.round(F.col("fraud") / F.col("analyzed") * 100, 2)).otherwise(0.0).alias("message_flag_rate"),
    )


def top_findings(findings: DataFrame, n: int = 10, unmask: bool = False) -> DataFrame:
    masked = mask_domain(F.col("domain"))
    return (
        findings.orderBy(F.desc("risk_score"), F.desc("id"))
        .limit(n)
        .withColumn("domain_masked", masked)
        .withColumn("domain", F.col("domain") if unmask else masked)
    )


def snapshot_sections(daily: DataFrame, findings: DataFrame, runs: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The sections of an export: all days, the 50 best findings, the last 20 runs, and how many rows each table has."""
    return {
        "table_counts": table_counts(tables),
        "daily_stats": daily,
        "domain_findings": findings.orderBy(F.desc("risk_score"), F.desc("id")).limit(50),
        "collector_runs": runs.orderBy(F.desc("id")).limit(20),
    }


def top_of_day(findings: DataFrame, campaigns: DataFrame, day: str, n: int = 5) -> DataFrame:
    """Best findings of one UTC day with their campaign's size; the limit comes before the join."""
    start = F.lit(day).cast("timestamp")
    top = (
        findings.where((F.col("first_seen") >= start) & (F.col("first_seen") < start + F.expr("INTERVAL 1 DAY")))
        .orderBy(F.desc("risk_score"), "domain")
        .limit(n)
        .withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("risk_score"), "domain")))
    )
    return top.join(campaigns.select("cluster_type", "cluster_key", "member_count"), ["cluster_type", "cluster_key"], "left")


def category_list(category_findings: DataFrame, category: str, n: int = 50) -> DataFrame:
    rows = category_findings.where(F.col("category") == category)
    return (
        rows.orderBy(F.desc("is_hijacked_institution"), F.desc("first_seen"), "domain")
        .limit(n)
        .withColumn("risk_score", severity(F.col("category"), F.col("is_hijacked_institution")))
        .withColumn("risk_level", F.lit(scoring.FRAUD))
    )


def unified_feed(findings: DataFrame, category_findings: DataFrame) -> DataFrame:
    """All findings of the three categories in one shape."""
    fraud = findings.select(
        "id", "domain", "first_seen", F.lit("phishing").alias("category"), "matched_brand",
        F.lit(None).cast("string").alias("matched_keywords"), "risk_score", "risk_level", "is_live",
    )
    rest = category_findings.select(
        "id", "domain", "first_seen", "category", F.lit(None).cast("string").alias("matched_brand"), "matched_keywords",
        severity(F.col("category"), F.col("is_hijacked_institution")).cast("bigint").alias("risk_score"),
        F.lit(scoring.FRAUD).alias("risk_level"), F.lit(False).alias("is_live"),
    )
    return fraud.withColumn("risk_score", F.col("risk_score").cast("bigint")).unionByName(rest)


def activity_feed(findings: DataFrame, category_findings: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` of all categories, masked. A top-n of the union equals the top-n of per-category top-n."""
    return (
        unified_feed(findings, category_findings)
        .orderBy(F.desc("first_seen"), "category", "domain")
        .limit(n)
        .select("category", "matched_brand", "risk_score", "first_seen", mask_domain(F.col("domain")).alias("domain_masked"))
    )


def search_feed(
    feed: DataFrame, text: str | None = None, category: str | None = None, level: str | None = None, live: bool | None = None
) -> DataFrame:
    """Filters of the findings table: category, level, liveness, substring over all text columns."""
    if category:
        feed = feed.where(F.col("category") == category)
    if level:
        feed = feed.where(F.col("risk_level") == level)
    if live is not None:
        feed = feed.where(F.col("is_live") == live)
    if text:
        hay = F.concat_ws(" ", "matched_brand", F.replace("matched_keywords", F.lit(","), F.lit(" ")), "domain", mask_domain(F.col("domain")), "category")
        feed = feed.where(F.lower(hay).contains(text.lower()))
    return feed


def spotlight(feed: DataFrame, text: str, n: int = 8) -> DataFrame:
    return search_feed(feed, text).orderBy(F.desc("risk_score"), "category", "domain").limit(n)


def detail_lookup(feed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Row per wanted id: fraud findings first, then gambling, then adult."""
    order = F.when(F.col("category") == "phishing", 0).when(F.col("category") == "judol", 1).otherwise(2)
    hits = feed.join(wanted.select("id").distinct(), "id")
    cols = [c for c in feed.columns if c != "id"]
    return hits.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct(order, "domain")).alias("r")).select("id", "r.*")


def latest_by_domain(findings: DataFrame) -> DataFrame:
    """Newest row per host, for lookups by name."""
    cols = [c for c in findings.columns if c != "domain"]
    return findings.groupBy(F.lower("domain").alias("domain")).agg(F.max_by(F.struct(*cols), "id").alias("r")).select("domain", "r.*")


def live_status(is_live: Column, code: Column) -> Column:
    return (
        F.when(code.isNull(), F.when(is_live, "Live").otherwise("Not checked"))
        .when(code < 300, F.concat(code.cast("string"), F.lit(" OK Live")))
        .when(code < 400, F.concat(code.cast("string"), F.lit(" Redirect")))
        .otherwise(F.concat(code.cast("string"), F.lit(" Blocked")))
    )


def token_gate(calls: DataFrame, limit: int = DAILY_TOKEN_LIMIT) -> DataFrame:
    """Which calls a daily budget lets through: the sum of earlier accepted tokens is below the limit.

    Calls after the limit is reached are refused and use nothing, so the plain running sum decides.
    """
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    slices = F.floor(F.col("call_seq") / F.lit(CALL_SLICE)).cast("long")
    return running_sum(calls, ["date"], slices, ["call_seq"], total, "used_before", inclusive=False).withColumn(
        "allowed", F.col("used_before") < limit
    )


def export_columns(findings: DataFrame, masked: bool = True) -> DataFrame:
    """The six columns of the findings export."""
    return findings.select(
        (mask_domain(F.col("domain")) if masked else F.col("domain")).alias("Domain"),
        F.coalesce("matched_brand", F.lit("")).alias("Brand"),
        F.coalesce("risk_score", F.lit(0)).alias("Risk Score"),
        F.coalesce("risk_level", F.lit("")).alias("Risk Level"),
        F.when(F.col("is_live"), "Live").otherwise("Inactive").alias("Is Live"),
        F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("First Seen"),
    )
