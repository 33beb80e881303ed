"""Escalation channels, report drafts and the daily brief, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.plans.analytics import REPORT_ZONE, trailing_week

# --- fixed values: reporting channels (name, contact) and finance words -------------
CONTENT_CHANNEL = ("Aduan Konten Kominfo RI", "aduankonten@kominfo.go.id")
REGISTRY_CHANNEL = ("PANDI", "abuse@pandi.id")
FINANCE_CHANNEL = ("Kontak OJK 157 & Satgas PASTI", "konsumen@ojk.go.id")
CSIRT_CHANNEL = ("BSSN Gov-CSIRT", "bantuan70@bssn.go.id")
FINANCE_WORDS = ["bank", "bca", "bni", "bri", "mandiri", "dana", "ovo", "gopay", "ojk", "bi"]
HIJACKED_SCORE, CATEGORY_SCORE = 95, 85
FRAUD_LEVEL = "INDIKASI PENIPUAN"
# ----------------------------------------------------------------------------------
#: Kind of desk, how to reach it and what it does, by channel name.
DESKS = {
    CONTENT_CHANNEL[0]: ("content regulator", "complaint portal or mail", "blocks access to a site"),
    REGISTRY_CHANNEL[0]: ("registry of .id", "mail to the abuse desk", "suspends a domain name under .id"),
    FINANCE_CHANNEL[0]: ("financial regulator", "mail or telephone 157", "acts against unlicensed financial offers"),
    CSIRT_CHANNEL[0]: ("national incident response", "mail to the response team", "coordinates incidents of institutions"),
}


def recommended_channels(domain: Column, brand: Column, hijacked: Column | None = None) -> Column:
    """Array of (name, contact, target_type, submission_method, notes): always the content desk, then by zone, by brand, by hijack."""

    def channel(c: tuple[str, str]) -> Column:
        fields = dict(zip(("name", "contact", "target_type", "submission_method", "notes"), (*c, *DESKS[c[0]]), strict=True))
        return F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])

    low = F.lower(F.coalesce(brand, F.lit("")))
    finance = low.rlike("|".join(FINANCE_WORDS))
    csirt = finance if hijacked is None else finance | F.coalesce(hijacked, F.lit(False))
    return F.array_compact(
        F.array(
            channel(CONTENT_CHANNEL),
            F.when(F.lower(domain).endswith(".id"), channel(REGISTRY_CHANNEL)),
            F.when(finance, channel(FINANCE_CHANNEL)),
            F.when(csirt, channel(CSIRT_CHANNEL)),
        )
    )


def category_cases(findings: DataFrame) -> DataFrame:
    """Findings of the category scans in the columns that a draft needs.

    A scan looks at names only, so a case is never called live. A finding below an institution's domain counts as
    that institution's, and its response team is told.
    """
    hijacked = F.coalesce("is_hijacked_institution", F.lit(False))
    words = F.array_join(F.filter(F.split(F.coalesce("matched_keywords", F.lit("")), ","), lambda w: w != ""), ", ")
    content = F.when(F.col("category") == "porn", "Adult content").otherwise("Gambling content")
    institution = F.concat(F.lit("Official institution (."), F.coalesce("institution_suffix", F.lit("")), F.lit(")"))
    return findings.select(
        "id", "domain", "category", "first_seen",
        F.when(hijacked, institution).otherwise(content).alias("matched_brand"),
        F.when(hijacked, HIJACKED_SCORE).otherwise(CATEGORY_SCORE).alias("risk_score"),
        F.lit(FRAUD_LEVEL).alias("risk_level"),
        F.lit(False).alias("is_live"),
        F.concat(F.when(hijacked, "hijacked subdomain and keyword").otherwise("keyword"), F.lit(" ("), words, F.lit(")")).alias("match_method"),
        F.when(F.lower("domain").endswith(".id"), "PANDI").alias("registrar"),
        F.lit(None).cast("string").alias("nameservers"),
        hijacked.alias("hijacked"),
    )


def category_drafts(findings: DataFrame) -> DataFrame:
    """(id, domain, matched_brand, risk_score, channels, draft_text) per finding of a category scan."""
    return report_drafts(category_cases(findings), ["matched_brand", "risk_score"])


def report_drafts(findings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(id, domain, channels, draft_text) per finding, and the columns of ``keep``; the draft is for a person to review and send."""
    brand = F.coalesce(F.when(F.col("matched_brand") != "", F.col("matched_brand")), F.lit("Public institution"))
    rows = findings.withColumn("_brand", brand).withColumn(
        "channels", recommended_channels(F.col("domain"), F.col("_brand"), F.col("hijacked") if "hijacked" in findings.columns else None)
    )
    seen = F.concat(F.date_format(F.from_utc_timestamp("first_seen", REPORT_ZONE), "dd/MM/yyyy HH:mm:ss"), F.lit(" WIB"))
    status = F.when(F.col("is_live"), "ACTIVE (answers HTTP)").otherwise("NOT RESPONDING")
    text = F.concat_ws(
        "\n",
        F.lit("DRAFT REPORT: SUSPECTED PHISHING SITE"),
        F.lit("Built from public technical data; an operator must review and send it."),
        F.lit("I. FINDING"),
        F.concat(F.lit("Domain: "), "domain"),
        F.concat(F.lit("Impersonated institution: "), "_brand"),
        F.concat(F.lit("Risk: "), "risk_level", F.lit(" ("), F.col("risk_score").cast("string"), F.lit("/100)")),
        F.concat(F.lit("Status: "), status),
        F.concat(F.lit("First detected: "), F.coalesce(seen, F.lit("-"))),
        F.lit("II. EVIDENCE"),
        F.concat(F.lit("Method: "), F.coalesce("match_method", F.lit("similarity"))),
        F.concat(F.lit("Registrar: "), F.coalesce("registrar", F.lit("not on record"))),
        F.concat(F.lit("Name servers: "), F.coalesce("nameservers", F.lit("not on record"))),
        F.lit("III. CHANNELS"),
        F.array_join(
            F.transform("channels", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["name"], F.lit(" - "), c["contact"])), "\n"
        ),
        F.lit("IV. REQUEST"),
        F.concat(F.lit("Please act on '"), "domain", F.lit("', which imitates '"), "_brand", F.lit("'.")),
    )
    return rows.select("id", "domain", *(keep or []), "channels", text.alias("draft_text"))


def daily_brief(daily: DataFrame, top: DataFrame, day: str) -> DataFrame:
    """One row (date, brief) for ``day``. ``top`` holds the day's best few findings with ``rank``.

    A day without a stats row says so; it never looks like a day of zeros.
    """
    one = daily.sparkSession.range(1).select(F.lit(day).alias("date"))
    stats = daily.where(F.col("date") == day).select(
        "date", "domains_scanned", "domains_live", F.col("domains_flagged").alias("flagged")
    )
    change = trailing_week(daily).where(F.col("date") == day).select("date", "days", "avg_flagged", "pct_change", "direction")
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), "domain", F.lit(" imitates '"), F.coalesce("matched_brand", F.lit("-")),
        F.lit("', score "), F.col("risk_score").cast("string"),
        F.when(F.col("is_live"), ", live").otherwise(""),
        F.when(
            F.col("member_count") > 1,
            F.concat(F.lit(", one campaign with "), (F.col("member_count") - 1).cast("string"), F.lit(" more")),
        ).otherwise(""),
    )
    # at most the few rows of the day's top list
    lines = top.agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l")).select(
        F.array_join("l.line", "\n").alias("lines")
    )
    trend = (
        F.when(F.col("direction") == "too_little_history", "Trend: fewer than 3 earlier days.")
        .when(F.col("avg_flagged") == 0, F.concat(F.lit("Trend: "), F.col("flagged").cast("string"), F.lit(" today, none before.")))
        .otherwise(
            F.concat(
                F.lit("Trend: "), "direction", F.lit(" "), F.bround(F.abs("pct_change")).cast("int").cast("string"),
                F.lit("% against "), F.col("days").cast("string"), F.lit(" days."),
            )
        )
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Daily brief "), "date"),
        F.concat(F.lit("Scanned: "), F.col("domains_scanned").cast("string")),
        F.concat(F.lit("Flagged: "), F.col("flagged").cast("string")),
        F.concat(F.lit("Live: "), F.col("domains_live").cast("string")),
        F.when(F.col("lines") != "", F.col("lines")),
        trend,
    )
    missing = F.concat(F.lit("Daily brief "), "date", F.lit("\nNo data for this day."))
    return (
        one.join(stats, "date", "left")
        .join(change, "date", "left")
        .crossJoin(lines)  # both sides are one row
        .select("date", F.when(F.col("flagged").isNull(), missing).otherwise(text).alias("brief"))
    )
