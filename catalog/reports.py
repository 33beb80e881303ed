"""Analytics and report queries: A8-A26, A30-A33, A35, N2-N5, O1-O7, P6-P12, U1, U2, J9-J11, W10, W11."""

from __future__ import annotations

from pyspark.sql import functions as F

from brandsieve.operators import campaigns
from brandsieve.plans import analytics as A
from catalog.clusters import _SIG
from catalog.funnel import now
from catalog.registry import Inputs, query
from catalog.sqlparts import mask

ISO = "yyyy-MM-dd HH:mm:ss"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def half_even(expr: str, digits: int) -> str:
    return f"CAST(round_even({expr}, {digits}) AS DOUBLE)"


@query(
    "a8_n2_latest_day",
    """SELECT date, domains_scanned, tahap1_passed, tahap2_passed, tahap3_assessed, domains_flagged, domains_live, flagged_not_in_blacklist, collector_ok, heartbeat_ok, peak_ram_mb
       FROM daily_stats WHERE date = (SELECT max(date) FROM daily_stats)""",
)
def a8(i: Inputs):
    return A.latest_day(i.daily_stats).drop("messages_analyzed", "reports_drafted")


@query("a9_trend", "SELECT date, domains_scanned, domains_flagged FROM daily_stats ORDER BY date DESC LIMIT 14")
def a9(i: Inputs):
    return A.trend(i.daily_stats.select("date", "domains_scanned", "domains_flagged"))


@query(
    "a10_tld_distribution",
    f"""SELECT tld, n AS count, {half_even('CAST(n AS DOUBLE) / total * 100', 1)} AS pct, ends_with(tld, '.id') AS is_cctld FROM (
          SELECT tld, count(*) AS n, sum(count(*)) OVER () AS total FROM (
            SELECT '.' || CASE WHEN split_part(domain, '.', -2) IN ('co','web','my','biz','ac','sch','go','mil','or') THEN split_part(domain, '.', -2) || '.' ELSE '' END || split_part(domain, '.', -1) AS tld FROM findings) a
          GROUP BY tld) b ORDER BY n DESC, tld LIMIT 7""",
)
def a10(i: Inputs):
    return A.tld_distribution(i.findings)


@query(
    "a11_tactic_distribution",
    f"""SELECT id, count(f.m) AS count, {half_even('CAST(count(f.m) AS DOUBLE) / (SELECT count(*) FROM findings) * 100', 1)} AS pct
        FROM (VALUES ('typo','edit_distance'), ('keyword','keyword'), ('homoglyph','homoglyph'), ('subdomain','permutation')) t(id, m)
        LEFT JOIN (SELECT coalesce(match_method, 'edit_distance') AS m FROM findings) f USING (m) GROUP BY id""",
)
def a11(i: Inputs):
    return A.tactic_distribution(i.findings)


@query(
    "a12_hourly_velocity",
    """SELECT CAST(h AS INTEGER) AS hour, n AS count, row_number() OVER (ORDER BY n DESC, h) = 1 AS is_peak FROM (
         SELECT h, count(l) AS n FROM (SELECT unnest(range(24)) AS h) hs LEFT JOIN (
           SELECT hour(l) AS h, l FROM (SELECT first_seen + INTERVAL 7 HOUR AS l FROM findings) a WHERE CAST(l AS DATE) = (SELECT max(CAST(first_seen + INTERVAL 7 HOUR AS DATE)) FROM findings)) b USING (h) GROUP BY h) c""",
)
def a12(i: Inputs):
    return A.hourly_velocity(i.findings)


_SECTOR = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(coalesce(matched_brand, '')), '{'|'.join(words)}') THEN '{name}'" for name, words in A.SECTORS
) + f" ELSE '{A.OTHER_SECTOR}' END"


@query(
    "a13_sector_breakdown",
    f"""SELECT sector, CAST(n AS BIGINT) AS count, {half_even('CAST(n AS DOUBLE) / (SELECT count(*) FROM findings) * 100', 1)} AS pct
        FROM (SELECT {_SECTOR} AS sector, count(*) AS n FROM findings GROUP BY 1) a""",
)
def a13(i: Inputs):
    return A.sector_breakdown(i.findings)


@query(
    "a14_message_levels",
    """SELECT count(*) AS total, count(*) FILTER (risk_level = 'INDIKASI PENIPUAN') AS fraud, count(*) FILTER (risk_level = 'HATI-HATI') AS caution,
              count(*) FILTER (risk_level = 'AMAN') AS safe FROM message_analyses""",
)
def a14(i: Inputs):
    return A.level_counts(i.message_analyses)


@query(
    "a15_u1_table_counts",
    """SELECT 'ct_raw' AS table_name, count(*) AS row_count FROM ct_raw UNION ALL SELECT 'collector_runs', count(*) FROM collector_runs UNION ALL SELECT 'domain_findings', count(*) FROM findings
       UNION ALL SELECT 'daily_stats', count(*) FROM daily_stats UNION ALL SELECT 'category_findings', count(*) FROM category_findings""",
)
def a15(i: Inputs):
    return A.table_counts(
        {"ct_raw": i.ct_raw, "collector_runs": i.collector_runs, "domain_findings": i.findings, "daily_stats": i.daily_stats,
         "category_findings": i.category_findings}
    )


@query(
    "a16_lead_time",
    f"""SELECT {half_even('CAST(sum(us) AS DOUBLE) / (count(us) * 3600000000)', 1)} AS avg_lead_time_hours FROM (
          SELECT CASE WHEN blacklist_listed_at >= first_seen THEN epoch_us(blacklist_listed_at) - epoch_us(first_seen) END AS us FROM findings) a""",
)
def a16(i: Inputs):
    return A.avg_lead_time_hours(i.findings)


@query(
    "a17_top_brands",
    f"""SELECT matched_brand, count(*) AS count, CAST(max(risk_score) AS BIGINT) AS max_score, {half_even('avg(risk_score)', 1)} AS avg_score FROM findings
        WHERE matched_brand IS NOT NULL AND matched_brand <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def a17(i: Inputs):
    return A.top_brands(i.findings)


@query(
    "a18_category_totals",
    f"SELECT category, count(*) AS total, count(*) FILTER (is_hijacked_institution) AS hijacked, {TS.format('min(first_seen)')} AS earliest_first_seen FROM category_findings GROUP BY category",
)
def a18(i: Inputs):
    return A.category_totals(i.category_findings).withColumn("earliest_first_seen", F.date_format("earliest_first_seen", ISO))


@query(
    "a19_collector_uptime",
    f"SELECT count(*) AS total_runs, count(*) FILTER (status = 'ok') AS ok_runs, {half_even('CAST(count(*) FILTER (status = $$ok$$) AS DOUBLE) / count(*) * 100', 2)} AS uptime_pct FROM collector_runs",
)
def a19(i: Inputs):
    return A.collector_uptime(i.collector_runs)


@query(
    "a20_lifetime_totals",
    "SELECT max(peak_ram_mb) AS peak_ram_mb, CAST(sum(domains_scanned) AS BIGINT) AS total_scanned, CAST(sum(domains_flagged) AS BIGINT) AS total_flagged FROM daily_stats",
)
def a20(i: Inputs):
    return A.lifetime_totals(i.daily_stats)


_CASE = {
    **_SIG,
    "full_labels": "SELECT f.*, l.cluster_type, l.cluster_key FROM findings f JOIN labelled l USING (id)",
    "camp": "SELECT cluster_type, cluster_key, count(*) AS n FROM labelled WHERE cluster_type IS NOT NULL GROUP BY ALL",
    "big_ns": "SELECT cluster_key FROM camp WHERE cluster_type = 'nameserver' ORDER BY n DESC, cluster_key LIMIT 1",
    "big_brand": "SELECT cluster_key FROM camp WHERE cluster_type = 'brand_pattern' ORDER BY n DESC, cluster_key LIMIT 1",
}


def _case(t: str, b: str) -> str:
    return f"""SELECT '{t}' AS cluster_type, cluster_key, count(*) AS total_domains, count(*) FILTER (is_live) AS domains_still_live,
                      count(*) FILTER (in_public_blacklist_at_detection) AS domains_now_in_blacklist, {TS.format('min(first_seen)')} AS first_detected_at,
                      arg_min(coalesce(matched_brand, '-'), strftime(first_seen, '%Y%m%d%H%M%S') || lpad(CAST(id AS VARCHAR), 20, '0')) AS target_brand
               FROM full_labels WHERE cluster_type = '{t}' AND cluster_key = (SELECT cluster_key FROM {b}) GROUP BY cluster_key"""


@query("j11_a21_case_study", f"{_case('nameserver', 'big_ns')} UNION ALL {_case('brand_pattern', 'big_brand')}", _CASE)
def j11(i: Inputs):
    labelled = campaigns.label_findings(i.findings.withColumn("matched_brand", F.col("matched_brand")))
    parts = [
        A.largest_campaign(labelled, t).withColumn("cluster_type", F.lit(t)) for t in ("nameserver", "brand_pattern")
    ]
    return (
        parts[0].unionByName(parts[1])
        .withColumn("first_detected_at", F.date_format("first_detected_at", ISO))
        .withColumn("target_brand", F.coalesce("target_brand", F.lit("-")))
    )


@query(
    "a21_campaign_timeline",
    "SELECT strftime(first_seen, '%Y-%m-%d') AS date, count(*) AS count FROM full_labels WHERE cluster_key = (SELECT cluster_key FROM big_ns) AND cluster_type = 'nameserver' GROUP BY 1",
    _CASE,
)
def a21(i: Inputs):
    labelled = campaigns.label_findings(i.findings).where(F.col("cluster_type") == "nameserver")
    return A.campaign_timeline(labelled, A.largest_campaign(labelled, "nameserver")).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_WEIGHTS = ", ".join(
    f"('{b}', '{r}', {round(w * 100)})" for b, ws in [*A.REGION_WEIGHTS.items(), ("*", A.DEFAULT_WEIGHTS)] for r, w in zip(A.REGIONS, ws)
)


@query(
    "a22_j10_regional_exposure",
    """SELECT region, CAST(round_even(CAST(cents AS DOUBLE) / 100, 0) AS BIGINT) AS estimated_count, CAST(round_even(CAST(cents AS DOUBLE) / max(cents) OVER () * 100, 0) AS BIGINT) AS intensity_pct
       FROM (SELECT region, sum(c * w) AS cents FROM (SELECT matched_brand AS b, count(*) AS c FROM findings WHERE matched_brand IS NOT NULL GROUP BY 1) f
             JOIN weights ON weights.b = CASE WHEN f.b IN (SELECT b FROM weights) THEN f.b ELSE '*' END GROUP BY region) x""",
    {"weights": f"SELECT * FROM (VALUES {_WEIGHTS}) v(b, region, w)"},
)
def a22(i: Inputs):
    return A.regional_exposure(i.findings)


@query(
    "a23_message_activity",
    """SELECT risk_level, day, count(*) AS count, CAST(round_even(avg(latency_ms), 0) AS BIGINT) AS avg_latency_ms, count(*) FILTER (report_drafted) AS reports_drafted
       FROM (SELECT *, strftime(received_at, '%Y-%m-%d') AS day FROM message_analyses) a GROUP BY GROUPING SETS ((risk_level), (day), ())""",
)
def a23(i: Inputs):
    return A.message_activity(i.message_analyses)


@query(
    "a24_intake_per_day",
    """SELECT strftime(seen_at, '%Y-%m-%d') AS date_seen, count(*) AS total_domains, count(DISTINCT host) AS unique_domains, count(*) FILTER (source = 'ctlogs_id') AS source_count FROM cert GROUP BY 1""",
)
def a24(i: Inputs):
    return A.intake_per_day(i.cert.select(F.col("host").alias("domain"), F.col("seen_at").alias("first_seen"), "source"))


@query(
    "a25_runs_by_status",
    "SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok_runs, count(*) FILTER (status = 'partial') AS partial_runs, count(*) FILTER (status = 'failed') AS failed_runs FROM collector_runs",
)
def a25(i: Inputs):
    return A.runs_by_status(i.collector_runs)


@query(
    "a26_findings_by_level",
    f"""SELECT risk_level, count(*) AS count, {half_even('avg(risk_score)', 1)} AS avg_score, count(*) FILTER (is_live) AS live_count,
               count(*) FILTER (in_public_blacklist_at_detection) AS in_blacklist_at_detection FROM findings GROUP BY risk_level""",
)
def a26(i: Inputs):
    return A.findings_by_level(i.findings)


@query(
    "a30_n3_trailing_week",
    """SELECT date, domains_flagged, days, a AS avg_flagged, CASE WHEN a > 0 THEN (domains_flagged - a) / a * 100 END AS pct_change,
              CASE WHEN a IS NULL THEN 'too_little_history' WHEN a = 0 THEN CASE WHEN domains_flagged = 0 THEN 'stable' ELSE 'new' END
                   WHEN domains_flagged > a THEN 'up' WHEN domains_flagged < a THEN 'down' ELSE 'stable' END AS direction
       FROM (SELECT date, domains_flagged, days, CASE WHEN days >= 3 THEN CAST(s AS DOUBLE) / days END AS a FROM (
         SELECT date, domains_flagged, count(*) OVER w AS days, sum(domains_flagged) OVER w AS s FROM daily_stats
         WINDOW w AS (ORDER BY CAST(date AS DATE) RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)) b) c""",
)
def a30(i: Inputs):
    return A.trailing_week(i.daily_stats)


@query("a31_day_over_day", "SELECT date, domains_scanned, domains_scanned - lag(domains_scanned) OVER (ORDER BY date) AS delta FROM daily_stats")
def a31(i: Inputs):
    return A.day_over_day(i.daily_stats)


@query(
    "a32_stream_share",
    """SELECT CAST(round(s * 100.0 / (s + m)) AS INTEGER) AS ct_share_pct, 100 - CAST(round(s * 100.0 / (s + m)) AS INTEGER) AS message_share_pct,
              CAST(round(f * 100.0 / s, 2) AS DOUBLE) AS ct_flag_rate, CAST(round(fr * 100.0 / m, 2) AS DOUBLE) AS message_flag_rate
       FROM (SELECT (SELECT count(*) FROM ct_raw) AS s, (SELECT count(*) FROM findings) AS f, (SELECT count(*) FROM message_analyses) AS m,
                    (SELECT count(*) FROM message_analyses WHERE risk_level = 'INDIKASI PENIPUAN') AS fr) x""",
)
def a32(i: Inputs):
    return A.stream_share(i.ct_raw, i.findings, i.message_analyses)


_FEED = {
    "feed": """SELECT id, domain, first_seen, 'phishing' AS category, matched_brand, NULL AS matched_keywords, CAST(risk_score AS BIGINT) AS risk_score, risk_level, is_live FROM findings
               UNION ALL SELECT id, domain, first_seen, category, NULL, matched_keywords, CAST(CASE WHEN is_hijacked_institution THEN 95 WHEN category = 'judol' THEN 85 ELSE 80 END AS BIGINT),
                         'INDIKASI PENIPUAN', false FROM category_findings""",
    "hay": f"""SELECT *, lower(concat_ws(' ', matched_brand, replace(matched_keywords, ',', ' '), domain, {mask('domain')}, category)) AS h FROM feed""",
}


def feed(i: Inputs):
    return A.unified_feed(i.findings, i.category_findings)


@query("a33_u2_category_counts", "SELECT category, count(*) AS count FROM feed GROUP BY category", _FEED)
def a33(i: Inputs):
    return feed(i).groupBy("category").agg(F.count("*").alias("count"))


@query(
    "a35_token_budget_gate",
    """SELECT call_seq, date, CAST(used AS BIGINT) AS used_before, used < 100000 AS allowed FROM (
         SELECT *, coalesce(sum(prompt_tokens + completion_tokens) OVER (PARTITION BY date ORDER BY call_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM model_calls) a""",
)
def a35(i: Inputs):
    return A.token_gate(i.model_calls).select("call_seq", "date", "used_before", "allowed")


@query(
    "o1_top_findings",
    f"SELECT id, {mask('domain')} AS domain, matched_brand, CAST(risk_score AS BIGINT) AS risk_score, risk_level FROM findings ORDER BY findings.risk_score DESC, id DESC LIMIT 100",
)
def o1(i: Inputs):
    return A.top_findings(i.findings, 100).select("id", "domain", "matched_brand", "risk_score", "risk_level")


@query(
    "o2_j9_top_of_day",
    """SELECT f.domain, f.matched_brand, CAST(f.risk_score AS BIGINT) AS risk_score, f.cluster_type, camp.n AS member_count, CAST(row_number() OVER (ORDER BY f.risk_score DESC, f.domain) AS INTEGER) AS rank
       FROM (SELECT * FROM full_labels WHERE CAST(first_seen AS DATE) = DATE '1999-09-09' ORDER BY risk_score DESC, domain LIMIT 5) f LEFT JOIN camp USING (cluster_type, cluster_key)""",
    _CASE,
)
def o2(i: Inputs):
    labelled = campaigns.label_findings(i.findings)
    return A.top_of_day(labelled, campaigns.campaigns(labelled, now()), "1999-09-09").select(
        "domain", "matched_brand", "risk_score", "cluster_type", "member_count", "rank"
    )


@query(
    "o3_p11_category_list",
    f"""SELECT domain, {TS.format('first_seen')} AS first_seen, is_hijacked_institution, CAST(CASE WHEN is_hijacked_institution THEN 95 ELSE 85 END AS INTEGER) AS risk_score, 'INDIKASI PENIPUAN' AS risk_level
        FROM category_findings WHERE category = 'judol' ORDER BY is_hijacked_institution DESC, category_findings.first_seen DESC, domain LIMIT 50""",
)
def o3(i: Inputs):
    return A.category_list(i.category_findings, "judol").select(
        "domain", F.date_format("first_seen", ISO).alias("first_seen"), "is_hijacked_institution", "risk_score", "risk_level"
    )


@query(
    "o4_activity_feed",
    f"SELECT category, matched_brand, risk_score, {TS.format('first_seen')} AS first_seen, {mask('domain')} AS domain_masked FROM feed ORDER BY feed.first_seen DESC, category, domain LIMIT 20",
    _FEED,
)
def o4(i: Inputs):
    return A.activity_feed(i.findings, i.category_findings).withColumn("first_seen", F.date_format("first_seen", ISO))


@query("o7_last_runs", f"SELECT id, {TS.format('started_at')} AS started_at, source, fetched, status FROM collector_runs ORDER BY id DESC LIMIT 10")
def o7(i: Inputs):
    return A.last_runs(i.collector_runs).select("id", F.date_format("started_at", ISO).alias("started_at"), "source", "fetched", "status")


@query("p6_p8_feed_search", "SELECT id, category, domain, risk_score FROM hay WHERE risk_level = 'INDIKASI PENIPUAN' AND NOT is_live AND contains(h, 'toto')", _FEED)
def p6(i: Inputs):
    return A.search_feed(feed(i), "Toto", level="INDIKASI PENIPUAN", live=False).select("id", "category", "domain", "risk_score")


@query("p7_spotlight", "SELECT id, category, domain, risk_score FROM hay WHERE contains(h, 'bank') ORDER BY risk_score DESC, category, domain LIMIT 8", _FEED)
def p7(i: Inputs):
    return A.spotlight(feed(i), "bank").select("id", "category", "domain", "risk_score")


_ROW_ID = "((seq1 * 8 + seq4) * 1000000 + seq2) * 10000 + seq3"


@query(
    "p9_latest_by_domain",
    f"""SELECT lower(domain) AS domain, max({_ROW_ID}) AS id, arg_max(registrar, {_ROW_ID}) AS registrar FROM rdap_log GROUP BY 1""",
)
def p9(i: Inputs):
    return A.latest_by_domain(i.rdap_log.select("domain", F.expr(_ROW_ID).alias("id"), "registrar"))


@query(
    "p10_detail_lookup",
    """SELECT id, category, domain FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE category WHEN 'phishing' THEN 0 WHEN 'judol' THEN 1 ELSE 2 END, domain) AS r
         FROM feed WHERE id IN (SELECT event_id * 3 FROM events)) a WHERE r = 1""",
    _FEED,
)
def p10(i: Inputs):
    wanted = i.events.select((F.col("event_id") * 3).alias("id"))
    return A.detail_lookup(feed(i), wanted).select("id", "category", "domain")


@query(
    "p12_live_status",
    """SELECT CASE WHEN last_status_code IS NULL THEN CASE WHEN is_live THEN 'Live' ELSE 'Not checked' END WHEN last_status_code < 300 THEN last_status_code || ' OK Live'
                   WHEN last_status_code < 400 THEN last_status_code || ' Redirect' ELSE last_status_code || ' Blocked' END AS live_status, count(*) AS n FROM findings GROUP BY 1""",
)
def p12(i: Inputs):
    return i.findings.groupBy(A.live_status(F.col("is_live"), F.col("last_status_code")).alias("live_status")).agg(F.count("*").alias("n"))


@query(
    "w11_export_columns",
    f"""SELECT {mask('domain')} AS "Domain", coalesce(matched_brand, '') AS "Brand", CAST(risk_score AS BIGINT) AS "Risk Score", risk_level AS "Risk Level",
               CASE WHEN is_live THEN 'Live' ELSE 'Inactive' END AS "Is Live", {TS.format('first_seen')} AS "First Seen" FROM findings""",
)
def w11(i: Inputs):
    return A.export_columns(i.findings)


@query(
    "w10_snapshot_findings",
    f"SELECT id, domain, {TS.format('first_seen')} AS first_seen, CAST(risk_score AS BIGINT) AS risk_score FROM findings ORDER BY findings.risk_score DESC, id DESC LIMIT 50",
)
def w10(i: Inputs):
    return A.top_findings(i.findings, 50, unmask=True).select("id", "domain", F.date_format("first_seen", ISO).alias("first_seen"), "risk_score")
