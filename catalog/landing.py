"""Landing views: the given tables reshaped into the engine's input tables.

Each view is one SELECT that means the same in Spark SQL and in DuckDB; the few spellings that
differ are placeholders. In Spark they are lazy DataFrames over the given tables, in the SQL checks
CTEs. All views read whole tables.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

NOW = "2001-12-01 12:00:00"  # the fixed "now" of every time-dependent query

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_MACROS = {
    "spark": {
        "minutes": "make_dt_interval(0, 0, CAST({0} AS INT))",
        "hours": "make_dt_interval(0, CAST({0} AS INT))",
        "days": "make_dt_interval(CAST({0} AS INT))",
        "iso": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss\")",
        "ymd": "date_format({0}, 'yyyy-MM-dd')",
        "sha": "sha2({0}, 256)",
        "hostof": "regexp_extract({0}, '^https?://([^/?#:]+)', 1)",
        "json_k": "CAST(get_json_object({0}, '$.k') AS BIGINT)",
    },
    "duckdb": {
        "minutes": "to_minutes(CAST({0} AS BIGINT))",
        "hours": "to_hours(CAST({0} AS BIGINT))",
        "days": "to_days(CAST({0} AS INTEGER))",
        "iso": "strftime({0}, '%Y-%m-%dT%H:%M:%S')",
        "ymd": "strftime({0}, '%Y-%m-%d')",
        "sha": "sha256({0})",
        "hostof": "regexp_extract({0}, '^https?://([^/?#:]+)', 1)",
        "json_k": "CAST(json_extract_string({0}, '$.k') AS BIGINT)",
    },
}

VIEWS: dict[str, str] = {
    # 64 two-word brands; the words are aliases, so terms have 3 to 11 letters and brands share terms
    "watch": """
        SELECT CAST(row_number() OVER (ORDER BY p_name) - 1 AS BIGINT) AS brand_idx,
               p_name AS brand_name,
               split_part(p_name, ' ', 1) || ';' || split_part(p_name, ' ', 2) || ';my ' || p_name || '; ' AS aliases,
               replace(p_name, ' ', '') || '.com' AS official_domain,
               CASE WHEN p_name LIKE 'blue%' THEN 'pemerintah' WHEN p_name LIKE 'hot%' THEN 'logistik'
                    WHEN p_name LIKE 'red%' THEN 'ecommerce' ELSE 'bank' END AS category,
               'edit_distance' AS match_mode
        FROM (SELECT DISTINCT p_name FROM @part@) AS names
    """,
    "host_seed": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
               CAST(l_shipdate AS TIMESTAMP) AS not_before,
               CAST(l_shipdate AS TIMESTAMP) + [minutes:(l_orderkey * 37 + l_partkey) % 1440] AS seen_at,
               replace(p_name, ' ', '') AS term,
               split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
               l_orderkey % 32 AS kind,
               CASE l_partkey % 8 WHEN 0 THEN 'xyz' WHEN 1 THEN 'top' WHEN 2 THEN 'com' WHEN 3 THEN 'co.id'
                    WHEN 4 THEN 'go.id' WHEN 5 THEN 'ac.id' WHEN 6 THEN 'sch.id' ELSE 'web.id' END AS tld
        FROM @lineitem@ JOIN @part@ ON l_partkey = p_partkey
    """,
    "host_zone": """
        SELECT *, CASE
            WHEN kind = 0 THEN term || '.' || tld
            WHEN kind = 1 THEN term || '-login.' || tld
            WHEN kind = 2 THEN substr(term, 1, 3) || substr(term, 5) || '.' || tld
            WHEN kind = 3 THEN substr(term, 1, 2) || substr(term, 4, 1) || substr(term, 3, 1) || substr(term, 5) || '.' || tld
            WHEN kind = 4 THEN substr(term, 1, 4) || substr(term, 4) || '.' || tld
            WHEN kind = 5 THEN replace(replace(replace(term, 'o', '0'), 'i', '1'), 'e', '3') || '.' || tld
            WHEN kind = 6 THEN 'secure-' || w1 || '-' || w2 || '--id.' || tld
            WHEN kind = 7 THEN w2 || '.' || tld
            WHEN kind = 8 THEN replace(replace(term, 'o', 'о'), 'e', 'е') || '.' || tld
            WHEN kind = 9 THEN CASE w2 WHEN 'widget' THEN 'xn--wdget-n2e' WHEN 'ring' THEN 'xn--rng-jhd'
                                       WHEN 'rod' THEN 'xn--rd-fmc' ELSE 'xn--' || w2 || '--' END || '.' || tld
            WHEN kind = 10 THEN CASE l_suppkey % 6 WHEN 0 THEN 'slot' || (l_partkey % 1000) WHEN 1 THEN 'gacor88'
                    WHEN 2 THEN '88togel' WHEN 3 THEN 'toto-slot' WHEN 4 THEN 'maxwin4d' ELSE 'kamislot' END
                    || '.' || w1 || w2 || (l_suppkey % 50) || '.' || tld
            WHEN kind = 11 THEN CASE l_suppkey % 5 WHEN 0 THEN 'toto4d' WHEN 1 THEN 'bola-info' WHEN 2 THEN 'cuan88'
                    WHEN 3 THEN 'bolabasket' ELSE 'joker123' END || '.k' || (l_partkey % 60) || '.' || tld
            WHEN kind = 12 THEN CASE l_suppkey % 3 WHEN 0 THEN 'bokep' || (l_partkey % 100) WHEN 1 THEN 'xxx21'
                    ELSE 'sangeet' END || '.a' || (l_partkey % 70) || '.' || tld
            WHEN kind = 13 THEN CASE l_suppkey % 2 WHEN 0 THEN 'ewe' ELSE 'toket-z' END || '.b' || (l_partkey % 80) || '.' || tld
            WHEN kind = 14 THEN term || '.com'
            WHEN kind = 15 THEN substr(term, 2, 3) || substr(term, 6, 1) || substr(term, 5, 1) || substr(term, 7) || 's.' || tld
            WHEN kind = 16 THEN term || 'id.' || tld
            WHEN kind = 17 THEN 'my' || substr(term, 1, 5) || 'q' || substr(term, 6) || '.' || tld
            ELSE 'toko' || (l_suppkey % 97) || '-kota' || (l_partkey % 13) || '.' || tld END AS zone
        FROM host_seed
    """,
    "cert": """
        SELECT *, CASE l_suppkey % 5 WHEN 0 THEN '*.' || host WHEN 1 THEN upper(host) WHEN 2 THEN host || '.'
                                     WHEN 3 THEN '  ' || host || ' ' ELSE host END AS raw_name
        FROM (
            SELECT CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'www.' WHEN 2 THEN 'n' || l_orderkey || '.'
                        ELSE 'mail.n' || l_orderkey || '.' END || zone AS host,
                   zone, tld, not_before, seen_at, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
                   CASE WHEN l_linenumber % 7 = 6 THEN 'ctlogs_b' ELSE 'ctlogs_id' END AS source
            FROM host_zone
            UNION ALL
            SELECT [hostof:url] AS host, [hostof:url] AS zone, 'com' AS tld,
                   CAST('2000-06-01 00:00:00' AS TIMESTAMP) AS not_before,
                   CAST('2000-06-01 00:00:00' AS TIMESTAMP) + [minutes:page_id % 1440] AS seen_at,
                   page_id AS l_orderkey, page_id AS l_partkey, page_id AS l_suppkey, 1 AS l_linenumber,
                   1.0 AS l_extendedprice, 'ctlogs_id' AS source
            FROM @pages@
        ) AS h
    """,
    "ct_raw": """
        SELECT host AS domain, min(seen_at) AS first_seen, min(not_before) AS not_before, min(source) AS source
        FROM cert GROUP BY host
    """,
    # registration answers, several per zone over time; rank breaks equal fetch times
    "rdap_log": """
        SELECT zone AS domain,
               CASE WHEN l_partkey % 11 = 0 THEN NULL
                    ELSE [iso:CAST('2001-12-01 12:00:00' AS TIMESTAMP) - [hours:(l_partkey * 29 + l_suppkey) % 4000]]
                         || CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'Z' END END AS registration_date,
               'Registrar ' || (l_suppkey % 12) AS registrar,
               CASE WHEN l_suppkey % 3 = 0 THEN 'ns1.hothost.com;ns2.hothost.com'
                    WHEN l_suppkey % 7 = 0 THEN ''
                    ELSE 'ns1.prov' || (l_suppkey % 40) || '.co.id;ns9.dns.prov' || (l_partkey % 3) || '.net.' END AS nameservers,
               l_partkey % 10 = 0 AS is_not_found,
               CAST('2001-12-01 12:00:00' AS TIMESTAMP) - [hours:(l_suppkey * 17 + l_linenumber * 31) % 400] AS fetched_at,
               l_orderkey AS seq1, l_partkey AS seq2, l_suppkey AS seq3, l_linenumber AS seq4
        FROM cert
    """,
    "blacklist_log": """
        SELECT host AS domain,
               CASE l_partkey % 4 WHEN 0 THEN 'listed' WHEN 1 THEN 'unknown' ELSE 'not_listed' END AS status,
               CAST('2001-12-01 12:00:00' AS TIMESTAMP) - [minutes:(l_suppkey * 41 + l_orderkey) % 1200] AS checked_at,
               l_orderkey AS seq1, l_partkey AS seq2, l_suppkey AS seq3, l_linenumber AS seq4
        FROM cert WHERE l_partkey % 5 <> 0
    """,
    "probe_log": """
        SELECT host AS domain,
               CASE l_suppkey % 6 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 WHEN 3 THEN 503 ELSE 200 END AS status_code,
               CAST('2001-12-01 12:00:00' AS TIMESTAMP) - [minutes:(l_suppkey * 13 + l_partkey) % 2000] AS probed_at,
               l_orderkey AS seq1, l_partkey AS seq2, l_suppkey AS seq3, l_linenumber AS seq4
        FROM cert WHERE l_partkey % 3 <> 0
    """,
    # review verdicts on hosts that only carry an ambiguous keyword
    "verdicts": """
        SELECT domain, (length(domain) % 3 <> 0) AS is_match, 'looks ' || CAST(length(domain) AS VARCHAR(10)) AS reasoning
        FROM ct_raw WHERE domain LIKE '%toto4d%' OR domain LIKE '%cuan88%' OR domain LIKE '%bola-%' OR domain LIKE 'ewe.%' OR domain LIKE '%toket%'
    """,
    # findings as stored by earlier days; one order is one finding, a third of them on one brand
    "findings": """
        SELECT o_orderkey AS id, stem || '-' || CAST(o_orderkey AS VARCHAR(20)) || '.' || tld AS domain,
               seen AS first_seen, brand AS matched_brand, method AS match_method, risk_score,
               CASE WHEN risk_score >= 70 THEN 'INDIKASI PENIPUAN' WHEN risk_score > 39 THEN 'HATI-HATI' ELSE 'AMAN' END AS risk_level,
               o_orderkey % 3 = 1 AS is_live,
               CASE o_orderkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 302 WHEN 2 THEN 403 END AS last_status_code,
               o_custkey % 4 = 0 AS in_public_blacklist_at_detection,
               CASE WHEN o_custkey % 4 = 0 THEN seen + [minutes:(o_orderkey * 7) % 5000 - 900] END AS blacklist_listed_at,
               'Registrar ' || CAST(o_custkey % 9 AS VARCHAR(20)) AS registrar,
               CASE WHEN o_orderkey % 10 < 3 THEN 'ns1.hothost.com;ns2.hothost.com'
                    WHEN o_orderkey % 10 < 6 THEN NULL
                    WHEN o_orderkey % 10 = 6 THEN ' ; '
                    ELSE 'NS1.farm' || CAST(o_custkey % 200 AS VARCHAR(20)) || '.co.id; ns2.b' || CAST(o_custkey % 2 AS VARCHAR(20)) || '.net.' END AS nameservers
        FROM (
            SELECT *, CAST(o_orderdate AS TIMESTAMP) + [minutes:(o_orderkey * 53 + o_custkey) % 1440] AS seen,
                   20 + (o_custkey * 7 + o_orderkey) % 80 AS risk_score,
                   CASE WHEN o_orderkey % 3 = 0 THEN 'Shopee Indonesia' ELSE CASE o_custkey % 11
                        WHEN 0 THEN 'Bank Mandiri' WHEN 1 THEN 'Ruangguru' WHEN 2 THEN 'GoPay Indonesia' WHEN 3 THEN 'Pos Indonesia'
                        WHEN 4 THEN 'Ditjen Pajak' WHEN 5 THEN 'Tokopedia' WHEN 6 THEN 'Paxel Indonesia' WHEN 7 THEN 'Investree Indonesia'
                        WHEN 8 THEN 'Universitas Contoh' WHEN 9 THEN '' END END AS brand,
                   CASE o_custkey % 6 WHEN 0 THEN 'keyword' WHEN 1 THEN 'homoglyph' WHEN 2 THEN 'permutation' WHEN 3 THEN NULL ELSE 'edit_distance' END AS method,
                   CASE o_custkey % 4 WHEN 0 THEN 'promo' WHEN 1 THEN 'x' WHEN 2 THEN 'hadiahbesar' ELSE 'login.klik' END AS stem,
                   CASE o_orderkey % 7 WHEN 0 THEN 'xyz' WHEN 1 THEN 'co.id' WHEN 2 THEN 'com' WHEN 3 THEN 'go.id' WHEN 4 THEN 'my.id' WHEN 5 THEN 'id' ELSE 'co.uk' END AS tld
            FROM @orders@
        ) AS o
    """,
    "category_findings": """
        SELECT l_orderkey * 10 + l_linenumber AS id, domain, first_seen, category,
               CASE WHEN category = 'judol' THEN 'slot,toto' ELSE 'bokep' END AS matched_keywords,
               hijacked AS is_hijacked_institution, CASE WHEN hijacked THEN 'go.id' END AS institution_suffix
        FROM (
            SELECT l_orderkey, l_linenumber, 'slot' || CAST(l_partkey AS VARCHAR(20)) || '.s' || CAST(l_orderkey AS VARCHAR(20)) || 'x' || CAST(l_suppkey AS VARCHAR(20)) || CASE WHEN l_suppkey % 4 = 0 THEN '.go.id' ELSE '.com' END AS domain,
                   CAST(l_shipdate AS TIMESTAMP) + [minutes:(l_orderkey * 11 + l_suppkey) % 1440] AS first_seen,
                   CASE WHEN l_partkey % 3 = 0 THEN 'porn' ELSE 'judol' END AS category, l_suppkey % 4 = 0 AS hijacked
            FROM @lineitem@
        ) AS c
    """,
    "daily_stats": """
        SELECT [ymd:o_orderdate] AS date,
               count(*) * 40 AS domains_scanned,
               count(*) * 3 AS tahap1_passed, count(*) * 2 AS tahap2_passed, count(*) * 2 AS tahap3_assessed,
               count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS domains_flagged,
               count(CASE WHEN o_orderkey % 4 = 0 THEN 1 END) AS domains_live,
               count(CASE WHEN o_orderkey % 6 <> 0 THEN 1 END) AS flagged_not_in_blacklist,
               max(o_custkey % 500) AS peak_ram_mb,
               max(o_custkey) % 5 <> 0 AS collector_ok, min(o_custkey) % 3 <> 0 AS heartbeat_ok,
               count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS messages_analyzed,
               count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS reports_drafted
        FROM @orders@ GROUP BY [ymd:o_orderdate]
    """,
    "collector_runs": """
        SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS started_at,
               CASE WHEN event_id % 7 <> 3 THEN CAST(ts AS TIMESTAMP) + [minutes:event_id % 90] END AS finished_at,
               CASE WHEN user_id % 3 = 0 THEN 'ctlogs_b' ELSE 'ctlogs_id' END AS source,
               user_id * 10 AS fetched, user_id AS inserted_new,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'ok' END AS status
        FROM @events@
    """,
    "message_analyses": """
        SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS received_at, event_type AS channel,
               user_id % 4 AS urls_found, (user_id * 13 + event_id) % 101 AS risk_score,
               CASE WHEN (user_id * 13 + event_id) % 101 >= 70 THEN 'INDIKASI PENIPUAN'
                    WHEN (user_id * 13 + event_id) % 101 > 39 THEN 'HATI-HATI' ELSE 'AMAN' END AS risk_level,
               [json_k:props] * 3 AS latency_ms, user_id % 8 = 0 AS report_drafted
        FROM @events@
    """,
    "model_calls": """
        SELECT event_id AS call_seq, [ymd:ts] AS date, [json_k:props] * 20 AS prompt_tokens, user_id * 5 AS completion_tokens
        FROM @events@
    """,
    # messages: whole document and conversation texts with planted scam fragments
    "messages": """
        SELECT msg_id, label, CASE seed % 12
            WHEN 0 THEN 'Segera konfirmasi OTP anda di hxxps://bca-promo[.]xyz/klaim?id=' || CAST(seed AS VARCHAR(20)) || ' sekarang. ' || text
            WHEN 1 THEN text || ' Silakan transfer dana ke rek BCA 12345678' || CAST(10 + seed % 90 AS VARCHAR(20)) || ' atau hubungi 0812-3456-78' || CAST(10 + seed % 90 AS VARCHAR(20))
            WHEN 2 THEN 'Pemberitahuan resmi: unduh aplikasi tagihan.apk dari www.redwidget-login.top/apk, terima kasih. ' || text
            WHEN 3 THEN text || chr(10) || 'Selamat anda menang undian berhadiah 10 juta! chat wa.me/62812345678' || CAST(seed % 10 AS VARCHAR(20))
            WHEN 4 THEN 'Jangan berikan kode verifikasi atau PIN kepada siapa pun. ' || text
            WHEN 5 THEN text || ' kunjungi smallr1ng dot com slash login, BNI no. rekening: 99887766' || CAST(10 + seed % 90 AS VARCHAR(20))
            WHEN 6 THEN 'Peringatan: akun menunggak denda, bayar sebelum jam 5 lewat t.me/petugas . NIK 320101010190' || CAST(1000 + seed % 9000 AS VARCHAR(20)) || ' under Budi Santoso. ' || text
            WHEN 7 THEN text || ' Dapatkan voucher dan cashback di https://User@Shop.Example.co.id:8080//promo//x?y=1#z!'
            ELSE text END AS text
        FROM (
            SELECT 'd' || CAST(doc_id AS VARCHAR(20)) AS msg_id, doc_id * 2 AS seed, text, CASE WHEN doc_id % 12 IN (0, 1, 3) THEN 'scam' ELSE 'legit' END AS label FROM @documents@
            UNION ALL
            SELECT 'c' || CAST(conv_id AS VARCHAR(20)) || '-' || CAST(turn AS VARCHAR(20)) AS msg_id, (conv_id * 64 + turn) * 2 + 1 AS seed, text, CASE WHEN turn = 0 THEN 'scam' ELSE 'legit' END AS label FROM @conversations@
        ) AS m
    """,
    # one page of two certificate rows per certificate; some timestamps are broken
    "ct_pages": """
        SELECT tld, source, '{"rows":[{"id":"' || CAST(l_orderkey AS VARCHAR(20)) || '","match":"' || raw_name || '","not_before":"'
               || CASE WHEN l_suppkey % 11 = 0 THEN 'no-date' ELSE [iso:not_before] || 'Z' END
               || '","san_count":2},{"id":"b","match":"' || CASE WHEN l_suppkey % 13 = 0 THEN '*.' ELSE 'alt.' || zone END || '","not_before":"'
               || [iso:seen_at] || '+00:00"}],"has_next":false}' AS payload
        FROM cert
    """,
    "san_records": """
        SELECT l_orderkey AS cert_id, raw_name || chr(10) || '*.' || upper(zone) || chr(10) || ' ' || chr(10) || 'mx.' || zone || '.' AS name_value FROM cert
    """,
    "rdap_json": """
        SELECT CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) AS answer_id,
               '{"ldhName":"' || upper(zone) || '","status":["active"," client hold ",""],"events":[{"eventAction":"last changed","eventDate":"1990-01-01T00:00:00Z"}'
               || CASE WHEN l_partkey % 5 = 0 THEN '' ELSE ',{"eventAction":"registration","eventDate":"' || [iso:not_before] || 'Z"},{"eventAction":"registration","eventDate":"1980-01-01T00:00:00Z"}' END
               || '],"nameservers":[{"ldhName":"NS1.' || zone || '."},{"handle":"ns2.' || zone || '"},{"ldhName":"ns1.' || zone || '"}],"entities":[{"roles":["abuse"],"handle":"NO"},{"roles":["'
               || CASE WHEN l_suppkey % 7 = 0 THEN 'technical' ELSE 'Registrar' END || '"]'
               || CASE l_suppkey % 3 WHEN 0 THEN ',"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text"," Reg ' || CAST(l_suppkey AS VARCHAR(20)) || ' Ltd "]]]' ELSE '' END
               || CASE l_suppkey % 3 WHEN 2 THEN ',"publicIds":[{"type":"id","identifier":"PID' || CAST(l_suppkey AS VARCHAR(20)) || '"}]' ELSE ',"handle":"H' || CAST(l_suppkey AS VARCHAR(20)) || '"' END
               || '}]}' AS payload, zone, l_suppkey, l_partkey, not_before
        FROM cert
    """,
    "bootstrap_docs": """
        SELECT s_suppkey AS doc_seq, '{"version":"1.0","services":[[["T' || CAST(s_nationkey AS VARCHAR(20)) || '",".u' || CAST(s_suppkey % 7 AS VARCHAR(20)) || '"],["https://r' || CAST(s_suppkey AS VARCHAR(20)) || '.test'
               || CASE WHEN s_suppkey % 2 = 0 THEN '/' ELSE '' END || '","https://second.test/"]],[["empty' || CAST(s_nationkey AS VARCHAR(20)) || '"],[]]]}' AS payload,
               s_nationkey
        FROM @supplier@
    """,
    "blacklist_json": """
        SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '{"query_status":"ok","urls":[{"id":"' || CAST(c_custkey AS VARCHAR(20)) || '"}' || CASE WHEN c_custkey % 8 = 0 THEN ',{"id":"b"}' ELSE '' END || ']}'
               WHEN 1 THEN '{"query_status":"no_results"}' WHEN 2 THEN '{"query_status":"invalid_host"}' ELSE 'not json' END AS payload
        FROM @customer@
    """,
    "snapshot_docs": """
        SELECT '{"daily_stats":[{"date":"' || [ymd:o_orderdate] || '","domains_flagged":' || CAST(o_custkey % 50 AS VARCHAR(20)) || '}],"collector_runs":[{"id":' || CAST(o_orderkey AS VARCHAR(20)) || ',"status":"ok"},{"id":1,"status":"'
               || CASE WHEN o_custkey % 2 = 0 THEN 'ok' ELSE 'failed' END || '"}]}' AS payload, o_custkey, o_orderdate
        FROM @orders@
    """,
    # observed responses: a shared landing chain behind every third order, loops, dead ends
    "responses": """
        SELECT 'https://r' || CAST(o_orderkey AS VARCHAR(20)) || '.test/a' AS url, CASE o_orderkey % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 301 WHEN 3 THEN 302 WHEN 4 THEN 307 ELSE 308 END AS status_code,
               CASE o_orderkey % 6 WHEN 2 THEN '/b/' WHEN 3 THEN 'https://r' || CAST(o_orderkey + 1 AS VARCHAR(20)) || '.test/a' WHEN 4 THEN '//r' || CAST(o_orderkey + 1 AS VARCHAR(20)) || '.test/a' WHEN 5 THEN 'c?x=1' END AS location
        FROM @orders@
        UNION ALL
        SELECT 'https://r' || CAST(o_orderkey AS VARCHAR(20)) || '.test/b/' AS url, CASE WHEN o_orderkey % 4 = 2 THEN 302 ELSE 303 END AS status_code,
               CASE WHEN o_orderkey % 4 = 2 THEN 'https://R' || CAST(o_orderkey AS VARCHAR(20)) || '.test/A/' ELSE 'https://r' || CAST(o_orderkey + 1 AS VARCHAR(20)) || '.test/a' END AS location
        FROM @orders@ WHERE o_orderkey % 6 = 2
        UNION ALL
        SELECT 'https://r' || CAST(o_orderkey AS VARCHAR(20)) || '.test/c?x=1' AS url, CASE WHEN o_orderkey % 12 = 5 THEN 301 ELSE 503 END AS status_code, NULL AS location
        FROM @orders@ WHERE o_orderkey % 6 = 5
    """,
}

#: In Spark, columns of a view that come out of a generator of one row: a filter or join on them stays above it.
#: Pushed below, it would have a copy of their long expressions, often several, for every certificate.
_ONCE = {
    "cert": """SELECT once.host, once.zone, tld, not_before, seen_at, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, source, raw_name
               FROM ({}) AS rows LATERAL VIEW explode(array(struct(host, zone))) AS once""",
    "ct_raw": "SELECT once AS domain, first_seen, not_before, source FROM ({}) AS rows LATERAL VIEW explode(array(domain)) AS once",
}


def _expand(sql: str, dialect: str) -> str:
    macros = _MACROS[dialect]
    pattern = re.compile(r"\[(" + "|".join(macros) + r"):([^\[\]]*)\]")
    while pattern.search(sql):
        sql = pattern.sub(lambda m: macros[m.group(1)].format(m.group(2)), sql)
    return sql


def _needed(sql: str) -> list[str]:
    """View names a statement uses, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return [v for v in VIEWS if v in found]


def shared_folder(spark: SparkSession) -> str:
    """Where tables that must be files go: the configured checkpoint folder, or the session's warehouse.

    The default warehouse is a folder of the driver's machine, so a cluster needs one of the two set to
    storage that all executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base}/landing-{uuid.uuid4().hex}"


#: Session setting: a folder where ``land`` has written views as tables.
LANDED = "spark.brandsieve.landed"


def land(spark: SparkSession, sf_dir: str, folder: str, names: list[str], files: int) -> None:
    """Write views as tables, as a deployment has them, and let this session read them from there."""
    for name in names:
        spark_view(spark, sf_dir, name).repartition(files).write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.conf.set(LANDED, f"{sf_dir}|{folder}|{','.join(names)}")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landing view: lazy over the given tables, or over those of ``land``."""
    source, _, rest = spark.conf.get(LANDED, "").partition("|")
    folder, _, names = rest.partition("|")
    landed = names.split(",") if source == sf_dir else []
    if name in landed:
        return spark.read.parquet(f"{folder}/{name}")
    views = {v: _ONCE.get(v, "{}").format(sql) for v, sql in VIEWS.items()}
    body = views[name]
    for v in landed:
        body = re.sub(rf"\b(FROM|JOIN)\s+{v}\b", rf"\1 parquet.`{folder}/{v}`", body)
    ctes = ", ".join(f"{v} AS ({views[v]})" for v in _needed(body))
    sql = _expand(f"WITH {ctes} {body}" if ctes else body, "spark")
    return spark.sql(re.sub(r"@(\w+)@", lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", sql))


def check_sql(body: str, ctes: dict[str, str] | None = None) -> str:
    """A DuckDB statement with the landing views it needs, and further CTEs, in front."""
    extra = ctes or {}
    everything = body + " ".join(extra.values())
    parts = [f"{v} AS {'MATERIALIZED ' if v == 'ct_raw' else ''}({VIEWS[v]})" for v in _needed(everything)] + [f"{k} AS MATERIALIZED ({v})" for k, v in extra.items()]
    with_clause = f"WITH {', '.join(parts)} " if parts else ""
    return re.sub(r"@(\w+)@", r"\1", _expand(with_clause + body, "duckdb"))
