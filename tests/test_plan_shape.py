"""Costly expressions of the landing views and the scans are in a plan once, not again in every filter on them."""

import pytest

from brandsieve.session import build_session
from catalog import clusters  # noqa: F401
from catalog.landing import spark_view
from catalog.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_hosts_stay_above_their_views(spark):
    hosts = spark_view(spark, SF, "ct_raw")
    plan = optimised(hosts.where("domain LIKE '%toto4d%' AND length(domain) % 4 = 0"))
    assert plan.count("toto4d,") + plan.count("toto4d)") == 1 + optimised(hosts).count("toto4d,") + optimised(hosts).count("toto4d)")
    # the host of a certificate is put together once in each of the two branches of certificates
    assert plan.count("mail.n") == optimised(hosts).count("mail.n") == 1


def test_rebuild_summary_looks_for_keywords_once_a_scan(spark):
    plan = optimised(QUERIES["w6_a7_judol_rebuild_summary"](spark, SF))
    # three scans (strict, ambiguous, ambiguous counted), each with one pattern of whole hosts and one of labels
    assert plan.count("situsslot|slotgacor|") <= 8
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
