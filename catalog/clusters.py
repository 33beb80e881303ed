"""Category-scan and campaign queries: F11-F13, P5, W6, A7, J12, U3, F26, A4-A6, N4, W4."""

from __future__ import annotations

from pyspark.sql import functions as F

from brandsieve.functions.domains import nameserver_signature
from brandsieve.operators import campaigns, categories
from catalog.funnel import now
from catalog.registry import Inputs, query
from catalog.sqlparts import labels, registrable

ISO = "yyyy-MM-dd HH:mm:ss"


def _hits(words: list[str]) -> str:
    pattern = "^\\d{0,3}(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")\\d{0,3}d?$"
    return f"list_sort(list_distinct(list_filter(list_transform(labs, lambda x: regexp_extract(x, '{pattern}', 1)), lambda k: k <> '')))"


def _scan_ctes(cat: str) -> dict[str, str]:
    strict, amb = categories.KEYWORDS[cat, "strict"], categories.KEYWORDS[cat, "ambiguous"]
    return {
        "lab": f"SELECT domain, first_seen, {labels('domain')} AS labs FROM ct_raw",
        "hits": f"""SELECT domain, first_seen, {_hits(strict)} AS strict, {_hits(amb)} AS amb,
                    CASE WHEN ends_with(domain, '.go.id') THEN 'go.id' WHEN ends_with(domain, '.ac.id') THEN 'ac.id' WHEN ends_with(domain, '.sch.id') THEN 'sch.id'
                         WHEN ends_with(domain, '.or.id') THEN 'or.id' WHEN ends_with(domain, '.desa.id') THEN 'desa.id' END AS suffix FROM lab""",
        "flagged": """SELECT domain, first_seen, array_to_string(strict, ',') AS matched_keywords, suffix IS NOT NULL AS is_hijacked_institution, suffix AS institution_suffix,
                             'keyword' AS verification_method, NULL AS llm_reasoning FROM hits WHERE len(strict) > 0
                      UNION ALL
                      SELECT domain, first_seen, array_to_string(amb, ','), suffix IS NOT NULL, suffix, 'llm', trim(reasoning) FROM hits JOIN verdicts USING (domain)
                      WHERE len(strict) = 0 AND len(amb) > 0 AND is_match""",
    }


def _register(cat: str, tag: str):
    @query(
        f"{tag}_{cat}_scan",
        f"SELECT domain, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, '{cat}' AS category, matched_keywords, is_hijacked_institution, institution_suffix, verification_method, llm_reasoning FROM flagged",
        _scan_ctes(cat),
    )
    def scan(i: Inputs):
        return categories.scan(i.ct_raw, cat, i.verdicts).withColumn("first_seen", F.date_format("first_seen", ISO))

    @query(
        f"w6_a7_{cat}_rebuild_summary",
        """SELECT (SELECT count(*) FROM ct_raw) AS domains_scanned, count(*) AS domains_flagged, count(*) FILTER (is_hijacked_institution) AS hijacked_institutions_flagged,
                  count(*) FILTER (length(domain) % 4 <> 0) AS newly_inserted, count(*) FILTER (verification_method = 'llm') AS llm_confirmed,
                  (SELECT count(*) FROM hits WHERE len(strict) = 0 AND len(amb) > 0) AS llm_candidates_checked FROM flagged""",
        _scan_ctes(cat),
    )
    def summary(i: Inputs):
        """Hosts with a length divisible by four count as known from the run before."""
        flagged = categories.scan(i.ct_raw, cat, i.verdicts)
        known = i.ct_raw.where(F.length("domain") % 4 == 0).select("domain", F.col("first_seen").alias("detected_at"))
        return categories.scan_summary(i.ct_raw, categories.rebuild(flagged, known, now()), cat, i.verdicts)


_register("judol", "f11_p5")
_register("porn", "f12_p5")


@query(
    "j12_u3_rebuild_detected_at",
    """SELECT domain, CASE WHEN length(domain) % 4 = 0 THEN strftime(first_seen, '%Y-%m-%d %H:%M:%S') ELSE '2001-12-01 12:00:00' END AS detected_at,
              length(domain) % 4 <> 0 AS newly_inserted FROM flagged""",
    _scan_ctes("judol"),
)
def j12(i: Inputs):
    flagged = categories.scan(i.ct_raw, "judol", i.verdicts)
    known = i.ct_raw.where(F.length("domain") % 4 == 0).select("domain", F.col("first_seen").alias("detected_at"))
    return categories.rebuild(flagged, known, now()).select(
        "domain", F.date_format("detected_at", ISO).alias("detected_at"), "newly_inserted"
    )


# --- campaigns ---------------------------------------------------------------------

_SIG = {
    "ns": f"""SELECT id, string_agg(reg, ',' ORDER BY reg) AS sig FROM (
                SELECT DISTINCT id, {registrable('h')} AS reg FROM (
                  SELECT id, rtrim(lower(trim(unnest(string_split(nameservers, ';')))), '.') AS h FROM findings) a WHERE h <> '') b
              WHERE reg IS NOT NULL GROUP BY id""",
    "nsc": "SELECT sig, count(*) AS n FROM ns GROUP BY sig HAVING count(*) >= 2",
    "loose": """SELECT id, lower(trim(matched_brand)) AS b, lower(trim(coalesce(match_method, ''))) AS m, first_seen FROM findings
                WHERE matched_brand <> '' AND id NOT IN (SELECT id FROM ns JOIN nsc USING (sig))""",
    "ends": """SELECT *, row_number() OVER (PARTITION BY b, m ORDER BY n DESC, first_seen) AS r
               FROM (SELECT b, m, first_seen, count(*) OVER (PARTITION BY b, m ORDER BY first_seen RANGE BETWEEN INTERVAL '7 days 23:59:59.999999' PRECEDING AND CURRENT ROW) AS n FROM loose) e""",
    "brandc": "SELECT b, m, first_seen AS hi, first_seen - INTERVAL '7 days 23:59:59.999999' AS lo, n FROM ends WHERE r = 1 AND n >= 3",
    "labelled": """SELECT f.id, CASE WHEN nsc.sig IS NOT NULL THEN 'nameserver' WHEN brandc.b IS NOT NULL THEN 'brand_pattern' END AS cluster_type,
                          CASE WHEN nsc.sig IS NOT NULL THEN nsc.sig WHEN brandc.b IS NOT NULL THEN brandc.b || '|' || brandc.m END AS cluster_key
                   FROM findings f LEFT JOIN ns USING (id) LEFT JOIN nsc ON ns.sig = nsc.sig LEFT JOIN loose ON loose.id = f.id
                   LEFT JOIN brandc ON loose.b = brandc.b AND loose.m = brandc.m AND loose.first_seen BETWEEN lo AND hi""",
}


@query("f26_nameserver_signature", "SELECT f.id, ns.sig AS signature FROM findings f LEFT JOIN ns ON ns.id = f.id", _SIG)
def f26(i: Inputs):
    return i.findings.select("id", nameserver_signature(F.col("nameservers")).alias("signature"))


@query("a4_nameserver_clusters", "SELECT sig AS cluster_key, n AS member_count FROM nsc", _SIG)
def a4(i: Inputs):
    return campaigns.nameserver_clusters(i.findings)


@query(
    "n4_largest_time_window",
    """SELECT matched_brand, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS window_end, n AS member_count
       FROM (SELECT *, row_number() OVER (PARTITION BY matched_brand ORDER BY n DESC, first_seen) AS r
             FROM (SELECT matched_brand, first_seen, count(*) OVER (PARTITION BY matched_brand ORDER BY first_seen RANGE BETWEEN INTERVAL '7 days 23:59:59.999999' PRECEDING AND CURRENT ROW) AS n
                   FROM findings WHERE matched_brand IS NOT NULL) a) b WHERE r = 1""",
)
def n4(i: Inputs):
    rows = i.findings.where(F.col("matched_brand").isNotNull())
    return campaigns.largest_windows(rows, ["matched_brand"]).select(
        "matched_brand",
        F.date_format(F.timestamp_micros("window_end_us"), ISO).alias("window_end"),
        "member_count",
    )


@query("a5_campaign_labels", "SELECT id, cluster_type, cluster_key FROM labelled", _SIG)
def a5(i: Inputs):
    return campaigns.label_findings(i.findings).select("id", "cluster_type", "cluster_key")


@query(
    "a6_clustering_summary",
    """SELECT cluster_type, count(DISTINCT cluster_key) AS clusters, count(*) AS domains_labeled FROM labelled WHERE cluster_type IS NOT NULL GROUP BY cluster_type""",
    _SIG,
)
def a6(i: Inputs):
    return campaigns.summary(campaigns.label_findings(i.findings))


@query(
    "w4_campaign_upsert",
    """SELECT cluster_type, cluster_key, CASE WHEN n IS NOT NULL THEN n ELSE old_n END AS member_count, CASE WHEN old_n IS NOT NULL THEN '2000-01-01' ELSE '2001-12-01' END AS first_detected_at,
              CASE WHEN n IS NOT NULL THEN '2001-12-01' ELSE '2000-01-01' END AS last_updated_at
       FROM (SELECT cluster_type, cluster_key, count(*) AS n FROM labelled WHERE cluster_type IS NOT NULL GROUP BY ALL) c
       FULL JOIN (SELECT 'brand_pattern' AS cluster_type, lower(matched_brand) || '|' || match_method AS cluster_key, count(*) AS old_n
                  FROM findings WHERE matched_brand <> '' AND match_method IS NOT NULL GROUP BY ALL) o USING (cluster_type, cluster_key)""",
    _SIG,
)
def w4(i: Inputs):
    """The earlier table has one brand campaign per brand and method."""
    before = F.lit("2000-01-01").cast("timestamp")
    old = (
        i.findings.where((F.col("matched_brand") != "") & F.col("match_method").isNotNull())
        .groupBy(F.concat_ws("|", F.lower("matched_brand"), "match_method").alias("cluster_key"))
        .agg(F.count("*").alias("member_count"))
        .select(F.lit("brand_pattern").alias("cluster_type"), "cluster_key", "member_count",
                before.alias("first_detected_at"), before.alias("last_updated_at"))
    )
    new = campaigns.campaigns(campaigns.label_findings(i.findings), now()).drop("id")
    out = campaigns.upsert_campaigns(old, new)
    for c in ("first_detected_at", "last_updated_at"):
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    return out
