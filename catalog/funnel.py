"""Enrichment, funnel and write-semantics queries: J2-J6, J12, P3, P4, A3, W2-W9, W12, S9, F10, F22-F26, F34."""

from __future__ import annotations

from pyspark.sql import functions as F

from brandsieve.functions import scoring
from brandsieve.functions.domains import is_risky_tld
from brandsieve.operators import enrich, redirects, upsert
from brandsieve.plans import funnel
from catalog.landing import NOW
from catalog.registry import Inputs, query
from catalog.sqlparts import MATCH, RISKY, registrable

ISO = "yyyy-MM-dd HH:mm:ss"
NOW_SQL = f"TIMESTAMP '{NOW}'"
SEQ = ["seq1", "seq2", "seq3", "seq4"]


def now():
    return F.lit(NOW).cast("timestamp")


def _latest_sql(log: str, at: str) -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {at} DESC, seq1 DESC, seq2 DESC, seq3 DESC, seq4 DESC) AS newest "
        f"FROM {log}) x WHERE newest = 1"
    )


SNAP = {
    "rdap": _latest_sql("rdap_log", "fetched_at"),
    "blacklist": _latest_sql("blacklist_log", "checked_at"),
    "probe": _latest_sql("probe_log", "probed_at"),
}
AGE = (
    "CASE WHEN ends_with(registration_date, 'Z') THEN CAST(greatest(0, floor(epoch(" + NOW_SQL +
    " - strptime(registration_date, '%Y-%m-%dT%H:%M:%SZ')) / 86400)) AS INTEGER) END"
)


def rdap(i: Inputs):
    return enrich.latest(i.rdap_log, ["fetched_at", *SEQ])


def blacklist(i: Inputs):
    return enrich.latest(i.blacklist_log, ["checked_at", *SEQ])


def probe(i: Inputs):
    return enrich.latest(i.probe_log, ["probed_at", *SEQ])


@query(
    "w7_latest_registration",
    "SELECT domain, registration_date, registrar, nameservers, is_not_found, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM rdap",
    SNAP,
)
def w7(i: Inputs):
    return rdap(i).withColumn("fetched_at", F.date_format("fetched_at", ISO)).drop(*SEQ)


_J2 = f"""SELECT c.domain, CASE WHEN fresh THEN registration_date END AS registration_date, CASE WHEN fresh THEN registrar END AS registrar,
                 CASE WHEN fresh THEN nameservers END AS nameservers
          FROM (SELECT domain, {registrable('domain')} AS reg FROM ct_raw) c
          LEFT JOIN (SELECT *, fetched_at > {NOW_SQL} - INTERVAL 7 DAY AS fresh FROM rdap WHERE NOT is_not_found) r ON r.domain = c.reg"""


@query("j2_registration_enrichment", _J2, SNAP)
def j2(i: Inputs):
    return enrich.with_registration(i.ct_raw.select("domain"), rdap(i), now())


@query(
    "j3_registration_requests",
    f"""SELECT reg, coalesce(rdap_url, 'https://rdap.org/') || 'domain/' || reg AS url
        FROM (SELECT DISTINCT {registrable('domain')} AS reg FROM ct_raw) c
        LEFT JOIN (SELECT CASE s_nationkey % 4 WHEN 0 THEN 'xyz' WHEN 1 THEN 'id' WHEN 2 THEN 'com' ELSE 'net' END AS tld, 'https://r' || max(s_suppkey) || '/' AS rdap_url
                   FROM supplier GROUP BY 1 HAVING tld <> 'com') b ON b.tld = split_part(reg, '.', -1)
        WHERE reg IS NOT NULL AND reg NOT IN (SELECT domain FROM rdap WHERE fetched_at > {NOW_SQL} - CASE WHEN is_not_found THEN INTERVAL 24 HOUR ELSE INTERVAL 168 HOUR END)""",
    SNAP,
)
def j3(i: Inputs):
    """Endpoints from the suppliers; the one for ``com`` is out of date."""
    k = F.col("s_nationkey") % 4
    tld = F.when(k == 0, "xyz").when(k == 1, "id").when(k == 2, "com").otherwise("net")
    boot = i.supplier.groupBy(tld.alias("tld")).agg(
        F.concat(F.lit("https://r"), F.max("s_suppkey").cast("string"), F.lit("/")).alias("rdap_url")
    )
    boot = boot.withColumn("fetched_at", now() - F.when(F.col("tld") == "com", F.expr("INTERVAL 31 DAYS")).otherwise(F.expr("INTERVAL 2 DAYS")))
    return enrich.registration_requests(i.ct_raw, rdap(i), boot, now())


@query(
    "j4_blacklist_enrichment",
    f"""SELECT c.domain, CASE WHEN checked_at > {NOW_SQL} - CASE WHEN status = 'listed' THEN INTERVAL 12 HOUR ELSE INTERVAL 6 HOUR END THEN status ELSE 'unknown' END AS blacklist_status
        FROM ct_raw c LEFT JOIN blacklist b USING (domain)""",
    SNAP,
)
def j4(i: Inputs):
    return enrich.with_blacklist(i.ct_raw.select("domain"), blacklist(i), now())


@query(
    "j5_liveness",
    "SELECT c.domain, CAST(status_code AS INTEGER) AS last_status_code, coalesce(status_code < 400, false) AS is_live FROM ct_raw c LEFT JOIN probe p USING (domain)",
    SNAP,
)
def j5(i: Inputs):
    return enrich.with_liveness(i.ct_raw.select("domain"), probe(i))


@query(
    "w12_stale_negative_entries",
    f"SELECT domain FROM rdap WHERE is_not_found AND domain <> {registrable('domain')}",
    SNAP,
)
def w12(i: Inputs):
    return enrich.stale_negative_entries(rdap(i)).select("domain")


@query(
    "f10_domain_age",
    f"SELECT domain, registration_date, {AGE} AS age_days FROM rdap",
    SNAP,
)
def f10(i: Inputs):
    return rdap(i).select(
        "domain", "registration_date", scoring.domain_age_days(F.col("registration_date"), now()).alias("age_days")
    )


# Redirect chains: recursive walk, six looks at most.
_WALK = {
    "walk": """
    SELECT * FROM (WITH RECURSIVE w AS (
        SELECT url, url AS cur, [] :: VARCHAR[] AS seen, '' AS hops, 0 AS n_hops, CAST(NULL AS INTEGER) AS code, CAST(NULL AS VARCHAR) AS status, 0 AS step FROM responses
        UNION ALL
        SELECT url,
               CASE WHEN NOT looped AND moved THEN nxt ELSE cur END,
               CASE WHEN NOT looped THEN list_append(seen, rtrim(lower(cur), '/')) ELSE seen END,
               CASE WHEN NOT looped THEN hops || cur || ' ' || new_code || chr(10) ELSE hops END,
               n_hops + CASE WHEN looped THEN 0 ELSE 1 END,
               CASE WHEN looped THEN code ELSE new_code END,
               CASE WHEN looped THEN 'loop_detected' WHEN moved THEN NULL WHEN new_code IN (301,302,303,307,308) OR (new_code > 0 AND new_code < 400) THEN 'ok' ELSE 'unreachable' END,
               step + 1
        FROM (SELECT w.*, list_contains(seen, lower(rtrim(cur, '/'))) AS looped, coalesce(r.status_code, 0) AS new_code,
                     coalesce(r.status_code, 0) IN (301,302,303,307,308) AND r.location IS NOT NULL AS moved,
                     CASE WHEN starts_with(r.location, 'https://') THEN r.location WHEN starts_with(r.location, '//') THEN 'https:' || r.location
                          WHEN starts_with(r.location, '/') THEN regexp_extract(cur, '^(https://[^/]*)', 1) || r.location
                          ELSE regexp_extract(cur, '^(https://.*/)', 1) || r.location END AS nxt
              FROM w LEFT JOIN responses r ON r.url = w.cur WHERE w.status IS NULL AND step < 5) s
    ) SELECT * FROM w) v
    """
}


@query(
    "j6_redirect_chains",
    """SELECT url, cur AS final_url, CAST(n_hops AS INTEGER) AS n_hops, CAST(code AS INTEGER) AS last_status_code,
              coalesce(status, CASE WHEN list_contains(seen, lower(rtrim(cur, '/'))) THEN 'loop_detected' ELSE 'max_hops_exceeded' END) AS status, hops
       FROM walk WHERE status IS NOT NULL OR step = 5""",
    _WALK,
)
def j6(i: Inputs):
    r = i.responses
    line = lambda h: F.concat(h["url"], F.lit(" "), h["status_code"].cast("string"), F.lit("\n"))
    return redirects.trace(r.select("url"), r).withColumn("hops", F.array_join(F.transform("hops", line), ""))


# The whole funnel over every day of the tables.
_STAGES = {
    **MATCH,
    **SNAP,
    "evidence": _J2,
    "staged": f"""
        SELECT c.domain, c.first_seen, c.not_before, matched_brand, match_method, similarity_score, registration_date,
               CASE WHEN registration_date IS NOT NULL THEN registrar END AS registrar, CASE WHEN registration_date IS NOT NULL THEN nameservers END AS nameservers,
               {AGE} AS age, coalesce(p.status_code < 400, false) AS is_live, p.status_code,
               coalesce(b.status = 'listed' AND b.checked_at > {NOW_SQL} - INTERVAL 12 HOUR, false) AS in_blacklist,
               split_part(c.domain, '.', -1) AS tld
        FROM ct_raw c JOIN matched m USING (domain) LEFT JOIN evidence e USING (domain) LEFT JOIN blacklist b USING (domain) LEFT JOIN probe p USING (domain)""",
    "scored": f"""
        SELECT *, NOT coalesce(NOT is_live AND age > 90 AND similarity_score < 0.80, false) AS escalated,
               least(100, 25 + CASE WHEN age < 7 THEN 30 WHEN age < 30 THEN 20 WHEN age < 90 THEN 10 ELSE 0 END
                          + CASE WHEN tld IN {RISKY} THEN 15 ELSE 0 END + CASE WHEN in_blacklist THEN 20 ELSE 0 END) AS risk_score
        FROM staged""",
}


def hosts_of(i: Inputs, *columns: str):
    """All hosts with their first sight and the ``columns`` that the rows of a query need; others are not shuffled."""
    return i.ct_raw.select("domain", "first_seen", *columns)


def tagged(i: Inputs, *columns: str):
    listed = enrich.latest(enrich.maybe_listed(i.blacklist_log, now()), ["checked_at", *SEQ])
    return funnel.run_funnel(hosts_of(i, *columns), i.watch, rdap(i), listed, probe(i), now())


def _findings_sql(scored: str, at: str) -> str:
    return f"""SELECT domain, strftime(coalesce(not_before, first_seen), '%Y-%m-%d %H:%M:%S') AS first_seen, registration_date AS registered_at, registrar, nameservers, matched_brand, match_method,
              CAST(risk_score AS INTEGER) AS risk_score, CASE WHEN risk_score >= 70 THEN 'INDIKASI PENIPUAN' WHEN risk_score > 39 THEN 'HATI-HATI' ELSE 'AMAN' END AS risk_level,
              is_live, CAST(status_code AS INTEGER) AS last_status_code,
              concat_ws(' ', CASE WHEN age < 7 THEN 'Domain was registered ' || age || ' days ago, a strong sign of a throw-away fraud site.'
                                  WHEN age < 30 THEN 'Domain is less than one month old (' || age || ' days).' END,
                        'The address imitates \'\'' || matched_brand || '\'\' but is not that institution\'\'s domain.',
                        CASE WHEN tld IN ('xyz', 'top') THEN 'Uses a high-risk domain extension (.' || tld || ').' END,
                        CASE WHEN is_live THEN 'The domain answers (live).' END, CASE WHEN in_blacklist THEN 'Listed on the public blacklist.' END) AS reasoning,
              in_blacklist AS in_public_blacklist_at_detection, '{at}' AS blacklist_checked_at
       FROM {scored} WHERE escalated AND risk_score >= 40"""


def dated(out):
    for c in ("first_seen", "blacklist_checked_at"):
        out = out.withColumn(c, F.date_format(c, ISO))
    return out


STAGES, FINDINGS_SQL = _STAGES, _findings_sql("scored", NOW)


@query("p3_p4_funnel_findings", FINDINGS_SQL, STAGES)
def p3(i: Inputs):
    return dated(funnel.findings(tagged(i, "not_before"), now()))


# An earlier run of the funnel over part of the hosts, then the run of now over all.
EARLIER = "2001-11-28 12:00:00"
_RUNS = {
    **_STAGES,
    **{f"{k}_then": _STAGES[k].replace(NOW, EARLIER).replace("JOIN evidence e", "JOIN evidence_then e").replace("FROM staged", "FROM staged_then") for k in ("evidence", "staged", "scored")},
    "old": _findings_sql("scored_then", EARLIER) + " AND first_seen < TIMESTAMP '1996-01-01 00:00:00'",
    "new": _findings_sql("scored", NOW),
}
_FIRST = ["first_seen", "registered_at", "registrar", "nameservers", "matched_brand", "match_method", "in_public_blacklist_at_detection", "blacklist_checked_at"]


@query(
    "p3_w2_funnel_upsert",
    "SELECT coalesce(o.domain, n.domain) AS domain, "
    + ", ".join(f"CASE WHEN o.domain IS NOT NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in _FIRST)
    + ", "
    + ", ".join(f"CASE WHEN n.domain IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in funnel.UPSERT_COLUMNS)
    + " FROM old o FULL JOIN new n ON o.domain = n.domain",
    _RUNS,
)
def p3_w2(i: Inputs):
    """Two runs of the funnel into one findings table: the earlier one over part of the hosts, that of now over all."""
    then = F.lit(EARLIER).cast("timestamp")
    hosts = hosts_of(i, "not_before")
    part = hosts.where(F.col("first_seen") < F.lit("1996-01-01").cast("timestamp"))
    old = funnel.run_funnel(part, i.watch, rdap(i), blacklist(i), probe(i), then)
    new = funnel.run_funnel(hosts, i.watch, rdap(i), blacklist(i), probe(i), now())
    return funnel.upsert_findings(dated(funnel.findings(old, then)), dated(funnel.findings(new, now())))


@query(
    "a3_funnel_day_counters",
    """SELECT strftime(d, '%Y-%m-%d') AS date, domains_scanned, coalesce(t1, 0) AS tahap1_passed, coalesce(t2, 0) AS tahap2_passed, coalesce(t2, 0) AS tahap3_assessed,
              coalesce(fl, 0) AS domains_flagged, coalesce(lv, 0) AS domains_live, coalesce(nb, 0) AS flagged_not_in_blacklist
       FROM (SELECT CAST(first_seen AS DATE) AS d, count(*) AS domains_scanned FROM ct_raw GROUP BY 1) s
       LEFT JOIN (SELECT CAST(first_seen AS DATE) AS d, count(*) AS t1, count(*) FILTER (escalated) AS t2, count(*) FILTER (escalated AND risk_score >= 40) AS fl,
                         count(*) FILTER (escalated AND risk_score >= 40 AND is_live) AS lv, count(*) FILTER (escalated AND risk_score >= 40 AND NOT in_blacklist) AS nb
                  FROM scored GROUP BY 1) t USING (d)""",
    _STAGES,
)
def a3(i: Inputs):
    return funnel.day_counters(hosts_of(i), tagged(i)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_EMPTY_DAY = "1970-01-01"


@query(
    "a3_w3_daily_upsert",
    f"""SELECT coalesce(o.date, n.date) AS date, {', '.join(f"CASE WHEN n.date IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in funnel.COUNTERS)},
               coalesce(o.messages_analyzed, 0) AS messages_analyzed
        FROM (SELECT * FROM daily_stats) o FULL JOIN (
          SELECT strftime(d, '%Y-%m-%d') AS date, domains_scanned, coalesce(t1, 0) AS tahap1_passed, coalesce(t2, 0) AS tahap2_passed, coalesce(t2, 0) AS tahap3_assessed,
                 coalesce(fl, 0) AS domains_flagged, coalesce(lv, 0) AS domains_live, coalesce(nb, 0) AS flagged_not_in_blacklist
          FROM (SELECT CAST(first_seen AS DATE) AS d, count(*) AS domains_scanned FROM ct_raw GROUP BY 1) s
          LEFT JOIN (SELECT CAST(first_seen AS DATE) AS d, count(*) AS t1, count(*) FILTER (escalated) AS t2, count(*) FILTER (escalated AND risk_score >= 40) AS fl,
                            count(*) FILTER (escalated AND risk_score >= 40 AND is_live) AS lv, count(*) FILTER (escalated AND risk_score >= 40 AND NOT in_blacklist) AS nb
                     FROM scored GROUP BY 1) t USING (d)
          UNION ALL SELECT '{_EMPTY_DAY}', 0, 0, 0, 0, 0, 0, 0) n ON o.date = n.date""",
    _STAGES,
)
def a3_w3(i: Inputs):
    """The funnel's counters of all days and of one day without a host, into the daily table."""
    counters = funnel.day_counters(hosts_of(i), tagged(i))
    rows = counters.unionByName(funnel.counters_of_day(counters.limit(0), _EMPTY_DAY)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    old = i.daily_stats
    for c in set(funnel.COUNTERS) - set(old.columns):
        old = old.withColumn(c, F.lit(0).cast("bigint"))
    out = funnel.upsert_daily(old.select("date", *funnel.COUNTERS, "messages_analyzed"), rows)
    return out.withColumn("messages_analyzed", F.coalesce("messages_analyzed", F.lit(0)))


@query(
    "f22_f24_risk_scores",
    """SELECT risk_score, CASE WHEN risk_score >= 70 THEN 'INDIKASI PENIPUAN' WHEN risk_score > 39 THEN 'HATI-HATI' ELSE 'AMAN' END AS risk_level, count(*) AS n
       FROM (SELECT CAST(risk_score AS INTEGER) AS risk_score FROM scored) x GROUP BY ALL""",
    _STAGES,
)
def f22(i: Inputs):
    return tagged(i).groupBy("risk_score", "risk_level").agg(F.count("*").alias("n"))


_BACK = {**MATCH, **SNAP}


@query(
    "s9_f34_backlog_rescore",
    f"""SELECT domain, strftime(coalesce(not_before, first_seen), '%Y-%m-%d %H:%M:%S') AS first_seen, matched_brand, match_method, risk_score,
               CASE WHEN risk_score >= 70 THEN 'INDIKASI PENIPUAN' ELSE 'HATI-HATI' END AS risk_level, in_public_blacklist_at_detection
        FROM (SELECT domain, c.not_before, c.first_seen, matched_brand, match_method,
                     CAST(least(100, floor(similarity_score * 60) + CASE WHEN split_part(domain, '.', -1) IN {RISKY} THEN 15 ELSE 0 END + 20) AS INTEGER) AS risk_score,
                     coalesce(b.status = 'listed' AND b.checked_at > {NOW_SQL} - INTERVAL 12 HOUR, false) AS in_public_blacklist_at_detection
              FROM ct_raw c JOIN matched USING (domain) LEFT JOIN blacklist b USING (domain)
              WHERE c.not_before >= TIMESTAMP '1998-06-01 00:00:00') x""",
    _BACK,
)
def s9(i: Inputs):
    """Hosts with an older certificate count as processed."""
    done = F.when(F.col("not_before") < F.lit("1998-06-01").cast("timestamp"), F.col("first_seen"))
    out = funnel.rescore_backlog(i.ct_raw.withColumn("processed_at", done), i.watch, blacklist(i), now())
    return out.withColumn("first_seen", F.date_format("first_seen", ISO))


@query(
    "w9_mark_processed",
    """SELECT domain, CASE WHEN not_before < TIMESTAMP '1997-01-01 00:00:00' THEN strftime(first_seen, '%Y-%m-%d %H:%M:%S')
                           WHEN not_before < TIMESTAMP '1999-01-01 00:00:00' THEN '2001-12-01 12:00:00' END AS processed_at FROM ct_raw""",
)
def w9(i: Inputs):
    day = lambda d: F.lit(d).cast("timestamp")
    raw = i.ct_raw.withColumn("processed_at", F.when(F.col("not_before") < day("1997-01-01"), F.col("first_seen")))
    done = raw.where(F.col("not_before") < day("1999-01-01")).select("domain")
    return upsert.mark(raw, done, "domain", "processed_at", now()).select(
        "domain", F.date_format("processed_at", ISO).alias("processed_at")
    )


@query(
    "w2_finding_upsert",
    """SELECT coalesce(o.domain, n.domain) AS domain, coalesce(o.registrar, n.registrar) AS registrar,
              CASE WHEN n.domain IS NOT NULL THEN n.risk_score ELSE o.risk_score END AS risk_score,
              CASE WHEN n.domain IS NOT NULL THEN n.is_live ELSE o.is_live END AS is_live,
              strftime(coalesce(o.first_seen, n.first_seen), '%Y-%m-%d %H:%M:%S') AS first_seen
       FROM (SELECT domain, registrar, risk_score, is_live, first_seen FROM findings WHERE first_seen < TIMESTAMP '2000-01-01 00:00:00') o
       FULL JOIN (SELECT domain, registrar || ' II' AS registrar, least(100, risk_score + 5) AS risk_score, NOT is_live AS is_live, first_seen + INTERVAL 9 DAY AS first_seen
                  FROM findings WHERE first_seen >= TIMESTAMP '1999-01-01 00:00:00') n ON o.domain = n.domain""",
)
def w2(i: Inputs):
    cols = ["domain", "registrar", "risk_score", "is_live", "first_seen"]
    old = i.findings.where(F.col("first_seen") < F.lit("2000-01-01").cast("timestamp")).select(*cols)
    new = i.findings.where(F.col("first_seen") >= F.lit("1999-01-01").cast("timestamp")).select(
        "domain",
        F.concat("registrar", F.lit(" II")).alias("registrar"),
        F.least(F.lit(100), F.col("risk_score") + 5).alias("risk_score"),
        (~F.col("is_live")).alias("is_live"),
        (F.col("first_seen") + F.expr("INTERVAL 9 DAYS")).alias("first_seen"),
    )
    return upsert.upsert(old, new, ["domain"], [c for c in funnel.UPSERT_COLUMNS if c in cols]).withColumn(
        "first_seen", F.date_format("first_seen", ISO)
    )


@query(
    "w3_daily_stats_upsert",
    """SELECT coalesce(o.date, n.date) AS date, CASE WHEN n.date IS NOT NULL THEN n.domains_scanned ELSE o.domains_scanned END AS domains_scanned,
              CASE WHEN n.date IS NOT NULL THEN n.domains_flagged ELSE o.domains_flagged END AS domains_flagged,
              coalesce(o.collector_ok, n.collector_ok) AS collector_ok, CASE WHEN o.date IS NOT NULL THEN o.messages_analyzed ELSE 0 END AS messages_analyzed
       FROM (SELECT * FROM daily_stats WHERE date < '2000-01-01') o
       FULL JOIN (SELECT date, domains_scanned + 1 AS domains_scanned, 0 AS domains_flagged, true AS collector_ok FROM daily_stats WHERE date >= '1999-01-01') n ON o.date = n.date""",
)
def w3(i: Inputs):
    old = i.daily_stats.where("date < '2000-01-01'").select("date", "domains_scanned", "domains_flagged", "collector_ok", "messages_analyzed")
    new = i.daily_stats.where("date >= '1999-01-01'").select(
        "date", (F.col("domains_scanned") + 1).alias("domains_scanned"), F.lit(0).cast("bigint").alias("domains_flagged"),
        F.lit(True).alias("collector_ok"), F.lit(0).cast("bigint").alias("messages_analyzed"),
    )
    return upsert.upsert(old, new, ["date"], ["domains_scanned", "domains_flagged"])


@query(
    "w5_token_usage",
    """SELECT date, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
              CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, count(*) AS call_count FROM model_calls GROUP BY date""",
)
def w5(i: Inputs):
    return upsert.add_usage(i.model_calls)


@query(
    "w8_retention",
    "SELECT channel, count(*) AS kept FROM message_analyses WHERE received_at >= TIMESTAMP '2024-02-10 06:00:00' - INTERVAL 30 DAY GROUP BY channel",
)
def w8(i: Inputs):
    at = F.lit("2024-02-10 06:00:00").cast("timestamp")
    return upsert.within_retention(i.message_analyses, at, 30).groupBy("channel").agg(F.count("*").alias("kept"))


@query(
    "w8_purged",
    "SELECT count(*) AS purged FROM message_analyses WHERE received_at < TIMESTAMP '2024-02-10 06:00:00' - INTERVAL 30 DAY",
)
def w8b(i: Inputs):
    return upsert.purged_count(i.message_analyses, F.lit("2024-02-10 06:00:00").cast("timestamp"), 30)


@query(
    "f9_risky_tlds",
    f"SELECT split_part(domain, '.', -1) AS tld, split_part(domain, '.', -1) IN {RISKY} AS is_risky, count(*) AS n FROM ct_raw GROUP BY ALL",
)
def f9(i: Inputs):
    d = F.col("domain")
    return i.ct_raw.groupBy(F.substring_index(d, ".", -1).alias("tld"), is_risky_tld(d).alias("is_risky")).agg(F.count("*").alias("n"))
