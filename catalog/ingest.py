"""Intake and parsing queries: S2-S10, A1, A2, W1, F1-F4."""

from __future__ import annotations

from pyspark.sql import functions as F

from brandsieve.functions.domains import domain_labels, mask_domain, normalize_domain, registrable_domain
from brandsieve.functions.homoglyph import with_homoglyph_columns
from brandsieve.operators.upsert import insert_if_absent
from brandsieve.sources import ct, snapshots
from catalog.registry import Inputs, query
from catalog.sqlparts import folded, labels, mask, puny, registrable

ISO = "yyyy-MM-dd HH:mm:ss"
SINCE = "1998-01-01 00:00:00"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(
    "s2_ct_page_rows",
    f"""SELECT domain, source, {TS.format('not_before')} AS not_before, count(*) AS n FROM (
          SELECT host AS domain, source, not_before FROM cert WHERE l_suppkey % 11 <> 0
          UNION ALL SELECT 'alt.' || zone, source, seen_at FROM cert WHERE l_suppkey % 13 <> 0) x
        WHERE not_before >= TIMESTAMP '{SINCE}' GROUP BY ALL""",
)
def s2(i: Inputs):
    pages = ct.parse_ct_pages(i.ct_pages).drop("tld")
    rows = ct.ct_rows(pages, F.lit(SINCE).cast("timestamp"))
    return rows.groupBy("domain", "source", F.date_format("not_before", ISO).alias("not_before")).agg(F.count("*").alias("n"))


@query(
    "a1_earliest_certificate",
    f"""SELECT domain, {TS.format('min(not_before)')} AS not_before FROM (
          SELECT host AS domain, not_before FROM cert WHERE l_suppkey % 11 <> 0
          UNION ALL SELECT 'alt.' || zone, seen_at FROM cert WHERE l_suppkey % 13 <> 0) x GROUP BY domain""",
)
def a1(i: Inputs):
    rows = ct.ct_rows(ct.parse_ct_pages(i.ct_pages), F.lit("1900-01-01").cast("timestamp"))
    return ct.earliest_by_domain(rows).withColumn("not_before", F.date_format("not_before", ISO))


@query(
    "s3_san_names",
    """SELECT domain, count(*) AS n FROM (
         SELECT host AS domain FROM cert UNION ALL SELECT zone FROM cert UNION ALL SELECT 'mx.' || zone FROM cert) x GROUP BY domain""",
)
def s3(i: Inputs):
    return ct.san_names(i.san_records).groupBy("domain").agg(F.count("*").alias("n"))


@query("f1_normalize_domain", "SELECT DISTINCT raw_name, host AS domain FROM cert")
def f1(i: Inputs):
    return i.cert.select("raw_name", normalize_domain(F.col("raw_name")).alias("domain")).distinct()


@query("f3_registrable_domain", f"SELECT domain, {registrable('domain')} AS registrable FROM ct_raw")
def f3(i: Inputs):
    return i.ct_raw.select("domain", registrable_domain(F.col("domain")).alias("registrable"))


@query("f4_domain_labels", f"SELECT domain, array_to_string({labels('domain')}, '|') AS labels FROM ct_raw")
def f4(i: Inputs):
    return i.ct_raw.select("domain", F.array_join(domain_labels(F.col("domain")), "|").alias("labels"))


@query(
    "f5_f7_homoglyph_analysis",
    f"""SELECT domain, {puny('domain')} AS decoded_domain, {folded('domain')} AS normalized_domain,
               contains(domain, 'xn--') AS is_punycode, array_to_string(tags, ',') AS tags,
               len(tags) > 0 OR contains(domain, 'xn--') OR {folded('domain')} <> {puny('domain')} AS has_homoglyphs
        FROM (SELECT domain, list_filter([
            CASE WHEN contains(domain, 'xn--') THEN 'punycode_idn_encoding' END,
            CASE WHEN regexp_matches({puny('domain')}, '[авсдеєһіјкмнорѕтху]') THEN 'cyrillic_script_spoof' END,
            CASE WHEN regexp_matches({puny('domain')}, '[αβεηικνορτυχ]') THEN 'greek_script_spoof' END,
            CASE WHEN regexp_matches({puny('domain')}, '[a-z][013458][a-z]') THEN 'digit_substitution_leet' END,
            CASE WHEN contains({puny('domain')}, 'rn') OR contains({puny('domain')}, 'vv') THEN 'digraph_substitution' END],
            lambda t: t IS NOT NULL) AS tags FROM ct_raw) x""",
)
def f5(i: Inputs):
    return with_homoglyph_columns(i.ct_raw.select("domain")).select(
        "domain", "decoded_domain", "normalized_domain", "is_punycode",
        F.array_join("detected_spoofs", ",").alias("tags"), "has_homoglyphs",
    )


@query("f14_mask_domain", f"SELECT domain, {mask('domain')} AS masked FROM ct_raw")
def f14(i: Inputs):
    return i.ct_raw.select("domain", mask_domain(F.col("domain")).alias("masked"))




@query(
    "a2_fetch_status",
    """SELECT ok_zones, partial_zones, failed_zones, CASE WHEN ok_zones > 0 AND partial_zones = 0 AND failed_zones = 0 THEN 'ok'
              WHEN ok_zones > 0 OR partial_zones > 0 THEN 'partial' ELSE 'failed' END AS status
       FROM (SELECT count(CASE WHEN NOT failed THEN 1 END) AS ok_zones, count(CASE WHEN failed AND n_domains > 0 THEN 1 END) AS partial_zones,
                    count(CASE WHEN failed AND n_domains = 0 THEN 1 END) AS failed_zones
             FROM (SELECT tld, count(*) FILTER (l_suppkey % 3 = 0) % 17 AS n_domains, max(l_orderkey) % 2 = 0 AS failed FROM cert GROUP BY tld) z) s""",
)
def a2(i: Inputs):
    zones = i.cert.groupBy("tld").agg(
        (F.count_if(F.col("l_suppkey") % 3 == 0) % 17).alias("n_domains"), (F.max("l_orderkey") % 2 == 0).alias("failed")
    )
    return ct.fetch_status(zones)


@query(
    "a2b_check_status",
    """SELECT source, checked, errors, CASE WHEN checked = 0 THEN 'failed' WHEN errors = 0 THEN 'ok' WHEN errors < checked THEN 'partial' ELSE 'failed' END AS status
       FROM (SELECT tld || source AS source, count(CASE WHEN l_suppkey % 2 = 0 THEN 1 END) AS checked, count(CASE WHEN l_suppkey % 2 = 1 AND l_partkey % 2 = 0 THEN 1 END) AS errors FROM cert GROUP BY 1) x""",
)
def a2b(i: Inputs):
    runs = i.cert.groupBy(F.concat("tld", "source").alias("source")).agg(
        F.count_if(F.col("l_suppkey") % 2 == 0).alias("checked"),
        F.count_if((F.col("l_suppkey") % 2 == 1) & (F.col("l_partkey") % 2 == 0)).alias("errors"),
    )
    return runs.withColumn("status", ct.check_status(F.col("checked"), F.col("errors")))




@query(
    "w1_insert_if_absent",
    f"""SELECT host AS domain, {TS.format('min(seen_at)')} AS first_seen FROM cert
        WHERE not_before >= TIMESTAMP '1999-01-01 00:00:00'
          AND host NOT IN (SELECT host FROM cert WHERE not_before < TIMESTAMP '1999-01-01 00:00:00') GROUP BY host""",
)
def w1(i: Inputs):
    """Hosts of the later certificates that the earlier ones do not have."""
    border = F.lit("1999-01-01").cast("timestamp")
    seen = i.cert.where(F.col("not_before") < border).select(F.col("host").alias("domain")).distinct()
    new = i.cert.where(F.col("not_before") >= border).groupBy(F.col("host").alias("domain")).agg(F.min("seen_at").alias("first_seen"))
    return insert_if_absent(seen, new, "domain").withColumn("first_seen", F.date_format("first_seen", ISO))


@query(
    "w13_run_log",
    """SELECT source, fetched, inserted_new, fetched - inserted_new AS duplicates FROM (
         SELECT source, count(*) AS fetched, count(DISTINCT host) AS inserted_new FROM cert GROUP BY source) x""",
)
def w13(i: Inputs):
    return (
        i.cert.groupBy("source")
        .agg(F.count("*").alias("fetched"), F.countDistinct("host").alias("inserted_new"))
        .withColumn("duplicates", F.col("fetched") - F.col("inserted_new"))
    )


@query(
    "s4_rdap_parse",
    f"""SELECT answer_id, CASE WHEN l_partkey % 5 <> 0 THEN strftime(not_before, '%Y-%m-%dT%H:%M:%SZ') END AS registration_date,
               CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'Reg ' || l_suppkey || ' Ltd'
                    WHEN l_suppkey % 3 = 1 THEN 'H' || l_suppkey ELSE 'PID' || l_suppkey END AS registrar,
               'ns1.' || zone || ',ns2.' || zone AS nameservers, 'active,client hold' AS status FROM rdap_json""",
)
def s4(i: Inputs):
    parsed = snapshots.parse_rdap(i.rdap_json.select("answer_id", "payload"))
    return parsed.withColumn("nameservers", F.array_join("nameservers", ",")).withColumn("status", F.array_join("status", ","))


@query(
    "s5_rdap_bootstrap",
    """SELECT tld, 'https://r' || max(doc_seq) || '.test/' AS rdap_url FROM (
         SELECT 't' || s_nationkey AS tld, doc_seq FROM bootstrap_docs UNION ALL SELECT 'u' || (doc_seq % 7), doc_seq FROM bootstrap_docs) x GROUP BY tld""",
)
def s5(i: Inputs):
    return snapshots.parse_bootstrap(i.bootstrap_docs)


@query(
    "s6_blacklist_parse",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'listed' WHEN 1 THEN 'not_listed' ELSE 'unknown' END AS status,
              CAST(CASE WHEN c_custkey % 8 = 0 THEN 2 WHEN c_custkey % 4 = 0 THEN 1 END AS INTEGER) AS reported_urls FROM blacklist_json""",
)
def s6(i: Inputs):
    return snapshots.parse_blacklist(i.blacklist_json)


@query("s7_labelled_samples", "SELECT label, count(*) AS n, sum(length(text)) :: BIGINT AS chars FROM messages GROUP BY label")
def s7(i: Inputs):
    lines = i.messages.select(
        F.to_json(F.struct(F.col("msg_id").cast("string").alias("id"), F.lit("message").alias("type"), F.col("text").alias("content"), "label")).alias("value")
    )
    return snapshots.parse_labelled(lines).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query(
    "s8_day_slice",
    f"SELECT domain, {TS.format('first_seen')} AS first_seen FROM ct_raw WHERE CAST(first_seen AS DATE) = DATE '2000-06-01'",
)
def s8(i: Inputs):
    from brandsieve.plans.funnel import day_slice

    return day_slice(i.ct_raw, "2000-06-01").select("domain", F.date_format("first_seen", ISO).alias("first_seen"))


@query(
    "s10_snapshot_tables",
    """SELECT 'daily_stats' AS table_name, strftime(o_orderdate, '%Y-%m-%d') AS key, count(*) AS n, CAST(sum(o_custkey % 50) AS BIGINT) AS total FROM snapshot_docs GROUP BY ALL
       UNION ALL SELECT 'collector_runs', 'ok', count(*) + count(*) FILTER (o_custkey % 2 = 0), 0 FROM snapshot_docs
       UNION ALL SELECT 'collector_runs', 'failed', count(*) FILTER (o_custkey % 2 = 1), 0 FROM snapshot_docs""",
)
def s10(i: Inputs):
    stats = snapshots.snapshot_table(i.snapshot_docs, "daily_stats", "date: STRING, domains_flagged: BIGINT")
    runs = snapshots.snapshot_table(i.snapshot_docs, "collector_runs", "id: BIGINT, status: STRING")
    return (
        stats.groupBy(F.lit("daily_stats").alias("table_name"), F.col("date").alias("key"))
        .agg(F.count("*").alias("n"), F.sum("domains_flagged").alias("total"))
        .unionByName(
            runs.groupBy(F.lit("collector_runs").alias("table_name"), F.col("status").alias("key")).agg(
                F.count("*").alias("n"), F.lit(0).cast("bigint").alias("total")
            )
        )
    )
