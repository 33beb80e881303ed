"""Distance and brand match against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from brandsieve.functions.distance import pairwise_distance
from brandsieve.operators.brand_match import find_similar, word_hits
from brandsieve.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")
    yield s
    s.stop()


def test_distance_counts_a_swap_once():
    assert pairwise_distance(["ca", "abcd", "", "same"], ["abc", "abdc", "xy", "same"]).tolist() == [2, 1, 2, 0]


def test_blocks_of_words_agree(spark):
    rnd = random.Random(7)
    words = ["kitabank", "senopati", "mandala", "tokobaru", "rumahku"]
    hosts = []
    for _ in range(300):
        w = list(rnd.choice(words))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(w))
            w[k : k + 1] = rnd.choice([[], [rnd.choice("abcdekmnot")], [w[k], w[k]]])
            w = w or ["a"]
        hosts.append(("".join(w) + rnd.choice([".xyz", ".co.id", "-login.top"]),))
    watch = spark.createDataFrame(
        [(k, w, "", f"{w}.co.id", "bank") for k, w in enumerate(words)],
        "brand_idx long, brand_name string, aliases string, official_domain string, category string",
    )
    df = spark.createDataFrame(hosts, "domain string")
    near = {tuple(r) for r in find_similar(df, watch).collect()}
    blocks = {tuple(r) for r in find_similar(df, watch, block_words=2).collect()}
    assert near and near == blocks


def test_label_hits_equal_all_pairs(spark):
    """Every label against every word by the exact distance and the shared-letter rule."""
    rnd = random.Random(3)
    letters = "abcdeilnorst0é日"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.choice([3, 4, 5, 6, 8, 9, 12, 20, 63]))) for _ in range(60)]
    labels = set(words[:10])
    for _ in range(500):
        w = list(rnd.choice(words))
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(w))
            w[k : k + 2] = rnd.choice([[], [rnd.choice(letters)], w[k : k + 2][::-1], [*w[k : k + 2], "a"]])
            w = w or ["a"]
        labels.add("".join(w))
    budget = lambda w: 0 if len(w) < 5 else 1 if len(w) == 5 else 2 if len(w) <= 8 else 3
    pairs = [(t, w) for t in labels for w in set(words) if abs(len(t) - len(w)) <= budget(w)]
    distance = dict(zip(pairs, pairwise_distance([t for t, _ in pairs], [w for _, w in pairs]).tolist()))
    expected = {(t, w, d) for (t, w), d in distance.items() if d <= budget(w) and (t == w or len(set(t) & set(w)) >= len(w) - budget(w))}
    roles = spark.createDataFrame([(w, budget(w), False) for w in set(words)], "word string, budget int, is_stem boolean")
    for size in (1000, 7):
        hits = word_hits(spark.createDataFrame([(f"{t}.x",) for t in labels if len(t) >= 3], "domain string"), roles, size)
        found = {(r["token"], r["word"], r["distance"]) for r in hits.where("kind = 0").collect()}
        assert found == {(t, w, d) for t, w, d in expected if len(t) >= 3}
    assert len(expected) > 100


def test_official_hosts_and_precedence(spark):
    watch = spark.createDataFrame(
        [(0, "Kita Bank", "KB", "kitabank.co.id", "bank")],
        "brand_idx long, brand_name string, aliases string, official_domain string, category string",
    )
    df = spark.createDataFrame(
        [("www.kitabank.co.id",), ("kitabank-login.xyz",), ("k1tabank.xyz",), ("kitabnak.xyz",), ("unrelated.com",)], "domain string"
    )
    got = {r["domain"]: r["match_method"] for r in find_similar(df, watch).collect()}
    assert got == {"kitabank-login.xyz": "keyword", "k1tabank.xyz": "homoglyph", "kitabnak.xyz": "edit_distance"}
