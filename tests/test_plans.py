"""Literal cases: links in messages, redirects, funnel upserts, latencies, tactics."""

import pytest
from pyspark.sql import functions as F

from brandsieve.functions import messages as M
from brandsieve.operators.redirects import trace
from brandsieve.plans import analytics, evaluate, funnel
from brandsieve.session import build_session


@pytest.fixture(scope="module")
def spark():
    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")


def test_links_of_messages(spark):
    texts = {
        "see hxxps://bca-promo[.]xyz/klaim?id=7 now": ["https://bca-promo.xyz/klaim?id=7"],
        "https://User@Shop.Example.co.id:8080//promo//x?y=1#z!": ["https://shop.example.co.id:8080/promo/x?y=1"],
        "no link here": [],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = M.evaluated_once(rows, "u", M.urls(F.col("text"))).collect()
    assert {r["text"]: r["u"] for r in got} == texts
    kept = M.evaluated_once(rows, "u", M.urls(F.col("text"))).where(F.size("u") > 0)
    assert kept.count() == 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_redirects_with_one_landing_page_for_all(spark):
    urls = spark.createDataFrame([(f"https://a{i}.test/",) for i in range(60)] + [("https://loop.test/",)], "url string")
    seen = [(f"https://a{i}.test/", 302, "https://hub.test/x") for i in range(54)] + [("https://hub.test/x", 200, None)]
    seen += [("https://loop.test/", 301, "/b"), ("https://loop.test/b", 301, "https://LOOP.test")]
    got = {r["url"]: r for r in trace(urls, spark.createDataFrame(seen, "url string, status_code int, location string")).collect()}
    assert len(got) == 61
    assert (got["https://a1.test/"]["final_url"], got["https://a1.test/"]["n_hops"], got["https://a1.test/"]["status"]) == ("https://hub.test/x", 2, "ok")
    assert (got["https://a59.test/"]["status"], got["https://a59.test/"]["last_status_code"]) == ("unreachable", 0)
    assert got["https://loop.test/"]["status"] == "loop_detected"


def test_findings_keep_what_was_first(spark):
    schema = "domain string, first_seen string, registrar string, risk_score int, risk_level string, is_live boolean, last_status_code int, reasoning string"
    old = spark.createDataFrame([("a.xyz", "d1", "R1", 50, "HATI-HATI", True, 200, "x")], schema)
    new = spark.createDataFrame([("a.xyz", "d2", "R2", 80, "INDIKASI PENIPUAN", False, 404, "y"), ("b.xyz", "d2", "R2", 45, "HATI-HATI", True, 200, "z")], schema)
    got = {r["domain"]: tuple(r)[1:] for r in funnel.upsert_findings(old, new).collect()}
    assert got["a.xyz"] == ("d1", "R1", 80, "INDIKASI PENIPUAN", False, 404, "y")
    assert got["b.xyz"] == ("d2", "R2", 45, "HATI-HATI", True, 200, "z")


def test_day_without_hosts_has_its_row(spark):
    none = spark.createDataFrame([], "date date, " + ", ".join(f"{c} long" for c in funnel.COUNTERS))
    row = funnel.counters_of_day(none, "2024-02-10").withColumn("text", funnel.ratio_text()).first()
    assert [row[c] for c in funnel.COUNTERS] == [0] * len(funnel.COUNTERS)
    assert row["text"].startswith("0 (scanned) -> 0 (brand match)")


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0, 3.0, 4.0], [7.0] * 50, [float(i * i % 997) for i in range(500)], [0.1, 1e6, 3.0] * 9])
def test_latency_percentiles(spark, values):
    ordered = sorted(values)
    n = len(ordered)
    middle = (ordered[(n + 1) // 2 - 1] + ordered[(n + 2) // 2 - 1]) / 2
    if n >= 20:
        j = min(max(19 * (n + 1) // 20, 1), n - 1)
        delta = 19 * (n + 1) - j * 20
        high = (ordered[j - 1] * (20 - delta) + ordered[j] * delta) / 20
    else:
        high = ordered[-1]
    got = evaluate.latency_percentiles(spark.createDataFrame([(v,) for v in values], "latency_ms double")).first()
    assert (got["p50"], got["p95"], got["min_ms"], got["max_ms"]) == pytest.approx((middle, high, ordered[0], ordered[-1]), abs=0.011)


def test_tactics_ignore_unknown_methods(spark):
    rows = spark.createDataFrame([("keyword",)] * 3 + [(f"odd{i}",) for i in range(40)] + [(None,)], "match_method string")
    got = {r["id"]: r["count"] for r in analytics.tactic_distribution(rows).collect()}
    assert sorted(got.values()) == [0, 0, 1, 3]


def test_hub_chains_and_hops(spark):
    """Nearly all urls lead to one page, whose chain has hops of its own."""
    seen = [(f"https://u{n}.test/", 301, "https://hub.test/in") for n in range(300)]
    seen += [("https://hub.test/in", 302, "/next"), ("https://hub.test/next", 200, None)]
    seen += [(f"https://c{n}.test/", 301, f"https://c{n + 1}.test/") for n in range(7)]
    rows = spark.createDataFrame(seen, "url string, status_code int, location string")
    urls = spark.createDataFrame([(u,) for u, _, _ in seen] + [("gone.test",), ("u1.test/",)], "url string")
    got = {r["url"]: r for r in trace(urls, rows).collect()}
    assert len(got) == len(seen) + 2
    for n in range(300):
        r = got[f"https://u{n}.test/"]
        assert [tuple(h) for h in r["hops"]] == [(f"https://u{n}.test/", 301), ("https://hub.test/in", 302), ("https://hub.test/next", 200)]
        assert (r["final_url"], r["n_hops"], r["status"], r["last_status_code"]) == ("https://hub.test/next", 3, "ok", 200)
    assert (got["https://c0.test/"]["status"], got["https://c0.test/"]["n_hops"], got["https://c0.test/"]["final_url"]) == ("max_hops_exceeded", 5, "https://c5.test/")
    assert (got["https://c3.test/"]["status"], got["https://c3.test/"]["n_hops"], got["https://c3.test/"]["last_status_code"]) == ("unreachable", 5, 0)
    assert [tuple(h) for h in got["gone.test"]["hops"]] == [("https://gone.test", 0)]
    assert got["u1.test/"]["n_hops"] == 3


def test_percentiles_with_an_outlier(spark):
    import statistics

    values = [float(n % 997) / 7 for n in range(100_000)] + [1e300]
    frame = spark.range(100_000).selectExpr("(id % 997) / 7D AS latency_ms").unionByName(spark.createDataFrame([(1e300,)], "latency_ms double"))
    got = evaluate.latency_percentiles(frame).first()
    assert got.p50 == round(statistics.median(values), 2)
    assert got.p95 == round(statistics.quantiles(values, n=20)[18], 2)
    assert got.max_ms == 1e300


def test_order_keys_keep_order_and_value(spark):
    import math
    import random
    import struct

    rng = random.Random(1)
    values = [0.0, 5e-324, 2.0**-1022, 2.0**-1023 * 1.5, 1.0, 2.0, 4.0, 1.7976931348623157e308, math.inf, 3.0, 1e-5]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(300)] + [math.nextafter(2.0**k, d) for k in range(-40, 40) for d in (0, math.inf)]
    values += [-v for v in values if v]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", evaluate.order_key(F.col("v")).alias("k"))
    for r in rows.withColumn("back", evaluate.from_order_key(F.col("k"))).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.k == (bits if r.v >= 0 else -bits) and r.back == r.v
