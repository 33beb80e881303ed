"""The funnel shuffles a host once for its match and its snapshots, and no columns that its rows do not need."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brandsieve.operators import brand_match, enrich, upsert
from brandsieve.session import build_session
from catalog import funnel
from catalog.registry import Inputs

SF = "/root/testdata/sf0.001"
NOW = datetime(2001, 12, 1, 12)


@pytest.fixture(scope="module")
def spark():
    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")


def planned(df) -> str:
    """The physical plan without adaptive execution, which hides what is planned twice."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.where(F.lit(True))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hits_of_a_host_are_shuffled_once(spark):
    # of known size, so that the watchlist is broadcast as in a run
    watch = spark.sql("SELECT * FROM VALUES (0L, 'Kita Bank', 'kita;bank', 'kitabank.co.id', 'bank') AS t(brand_idx, brand_name, aliases, official_domain, category)")
    hosts = spark.createDataFrame([("kitabnak.xyz", 2), ("KITABNAK.xyz.", 1), ("kita-bank.top", 3)], "domain string, seen int")
    found = brand_match.find_similar(hosts, watch, carry=["seen"])
    assert planned(found).count("hashpartitioning(domain") == 1
    rows = {r["domain"]: (r["match_method"], r["similarity_score"], r["matched_term"], r["seen"]) for r in found.collect()}
    assert rows == {"kitabnak.xyz": ("edit_distance", 0.88, "Kita Bank", 1), "kita-bank.top": ("keyword", 0.92, "kita", 3)}


def test_newest_row_carries_its_order_once(spark):
    rows = [("a", 1, 5, "old"), ("a", 2, 1, None), ("b", 1, 1, "x")]
    newest = upsert.latest_per_key(spark.createDataFrame(rows, "k string, at int, seq int, v string"), ["k"], ["at", "seq"])
    assert newest.columns == ["k", "at", "seq", "v"] and sorted(map(tuple, newest.collect())) == [("a", 2, 1, None), ("b", 1, 1, "x")]
    assert "max_by" not in planned(newest)
    maps = spark.createDataFrame([("a", 1, {"x": 1}), ("a", 2, {"x": 2})], "k string, at int, m map<string,int>")
    assert upsert.latest_per_key(maps, ["k"], ["at"]).collect()[0]["m"] == {"x": 2}


def test_answers_that_say_nothing_stay_at_home(spark):
    hours = lambda h: NOW - timedelta(hours=h)
    looks = [("a.x", "listed", hours(11)), ("b.x", "listed", hours(13)), ("c.x", "not_listed", hours(7)), ("d.x", "not_listed", hours(5)), ("e.x", "unknown", hours(1)), ("f.x", None, hours(1))]
    log = spark.createDataFrame(looks, "domain string, status string, checked_at timestamp")
    hosts = spark.createDataFrame([(f"{c}.x",) for c in "abcdefg"], "domain string")
    at = F.lit(str(NOW)).cast("timestamp")
    found = enrich.with_blacklist(hosts, log, at)
    expected = {"a.x": "listed", "b.x": "unknown", "c.x": "unknown", "d.x": "not_listed", "e.x": "unknown", "f.x": None, "g.x": "unknown"}
    assert dict(map(tuple, found.collect())) == dict(map(tuple, enrich.with_blacklist(hosts, enrich.maybe_listed(log, at), at).collect())) == expected
    join = next(line for line in planned(found).splitlines() if "Join" in line)
    assert "LeftOuter" in join and not re.search(r"Project \[.*checked_at", planned(found))


@pytest.mark.parametrize("query", [funnel.a3_w3, funnel.a3, funnel.p3, funnel.p3_w2])
def test_hosts_travel_with_what_the_rows_need(spark, query):
    plan = planned(query(Inputs(spark, SF)))
    assert "min(source" not in plan
    assert ("min(not_before" in plan) == (query in (funnel.p3, funnel.p3_w2))
