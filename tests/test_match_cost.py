"""What the brand match does for each row is bounded."""

import pytest

from brandsieve.functions import distance
from brandsieve.operators import brand_match
from brandsieve.session import build_session

WATCH = "brand_idx long, brand_name string, aliases string, official_domain string, category string"


@pytest.fixture(scope="module")
def spark():
    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hosts_become_tokens_once(spark):
    watch = spark.createDataFrame([(0, "Kita Bank", "", "kitabank.co.id", "bank")], WATCH)
    hosts = spark.createDataFrame([("kitabnak.xyz",)], "domain string")
    assert plan(brand_match.find_similar(hosts, watch)).count("ArrowEvalPython [_unicode_forms") == 1


def test_tokens_of_a_host(spark):
    hosts = spark.createDataFrame([("a1c..x-abc--def.k.co.id",)], "domain string")
    found = brand_match.host_tokens(hosts).orderBy("kind", "idx", "token")
    assert [(r["kind"], r["token"]) for r in found.collect()] == [
        (0, "a1c"), (0, "x-abc--def"), (0, "abc"), (0, "def"),
        (1, "--def"[1:]), (1, "abc"), (1, "abc-"), (1, "abc--def"), (1, "def"), (1, "x-abc"), (1, "x-abc-"),
        (2, "aic"), (2, "x-abc--def"), (2, "abc"), (2, "def"),
    ]


def test_known_distances_are_bounded(monkeypatch):
    monkeypatch.setattr(distance, "_KEPT", 3)
    monkeypatch.setattr(distance, "_known", {})
    pd = distance.pd
    for words in (["ab", "ba", "abc"], ["xy", "ab"], ["ab", "ab"]):
        got = distance.damerau_levenshtein.func(pd.Series(words), pd.Series(["ab"] * len(words)))
        assert got.tolist() == [{"ab": 0, "ba": 1, "abc": 1, "xy": 2}[w] for w in words]
        assert len(distance._known) <= 3
