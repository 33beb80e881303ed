import hashlib
from collections import defaultdict
from functools import partial
from itertools import combinations

import numpy as np
import pytest
import xxhash

from brandsieve.llm import components, exact_dedup, sharding, simhash

from .conftest import ODD


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_decisions_match_brute_force(make):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(i)
    got = exact_dedup.dedup_decisions(make(ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert r.doc_id in ids
    for sha in groups:
        kept = [r for r in got if r.text_sha256 == sha and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_exact_dedup_keeps_one_row_and_all_columns(make, bits):
    docs = make(ODD)
    got = exact_dedup.dedup(docs, max_bits=bits)
    rows = got.collect()
    assert got.columns == docs.columns
    assert sorted(lower(r.text) for r in rows) == sorted({lower(t) for _, t in ODD})
    assert {r.doc_id for r in rows if lower(r.text) == "same text"} == {6}


def test_exact_dedup_of_nothing(make):
    assert exact_dedup.dedup_decisions(make([])).count() == 0
    assert exact_dedup.dedup(make([])).count() == 0


def test_filter_never_misses_a_repeat(spark):
    digests = spark.range(4000).selectExpr("sha2(CAST(id % 3000 AS string), 256) AS digest", "id AS doc_id")
    bits = exact_dedup.filter_bits(4000)
    flagged = exact_dedup.flag_possible(digests, exact_dedup.repeated_filter(digests, bits), bits)
    repeated = flagged.groupBy("digest").count().where("count > 1").select("digest")
    assert flagged.join(repeated, "digest").where("NOT possible").count() == 0
    assert flagged.where("possible").count() < 2600  # 2000 repeat


def slow_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(documents):
    texts = [r.text for r in documents.limit(60).collect()] + ["", None, "one", "Two words", "a b c", "É a\x0bb\x0cc\x1cd"]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_fingerprint_agrees_with_spark_hash(spark):
    h = spark.sql("SELECT xxhash64('a b c') h").first().h
    assert simhash.fingerprint("A b  C") == h % (1 << 64)


def test_masks_cover_every_choice_of_bits():
    masks = simhash.covering_masks(2)
    for bits in combinations(range(64), 2):
        assert any(all(not m >> b & 1 for b in bits) for m in masks)


def slow_components(values, radius=2):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(sorted(values), 2):
        if bin((a ^ b) % (1 << 64)).count("1") <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {frozenset(w for w in values if find(w) == find(v)) for v in values}


@pytest.mark.parametrize("large", [2, 6, 2048])
def test_links_connect_as_brute_force_does(spark, large):
    rng = np.random.default_rng(large)
    values = set()
    for centre in rng.integers(-(1 << 63), (1 << 63) - 1, 12):
        near = int(centre)
        for _ in range(25):  # chains, stars and points just out of reach
            near ^= sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 4), replace=False))
            values.add(near)
            if rng.random() < 0.4:
                near = int(centre)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.links(fps, 2, large)
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= 2 or large > 2 for r in edges.collect())
    found = defaultdict(set)
    for r in components.components(edges).collect():
        found[r.component].add(r.node)
    linked = set().union(*found.values()) if found else set()
    assert {frozenset(v) for v in found.values()} | {frozenset([v]) for v in values - linked} == slow_components(values)


def test_near_duplicates_and_representatives(make):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [*ODD, (20, long), (21, long + " end"), (22, long.upper()), (23, "quite another text of some words")]
    got = simhash.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    fps = {(r.doc_id, r.fingerprint) for r in got}
    assert {(1, "0" * 16), (2, "0" * 16), (3, "0" * 16)} <= fps
    by_fp = {int(r.fingerprint, 16) - (1 << 64) * (int(r.fingerprint, 16) >> 63) for r in got}
    classes = slow_components(by_fp)
    for c in classes:
        members = [r for r in got if int(r.fingerprint, 16) - (1 << 64) * (int(r.fingerprint, 16) >> 63) in c]
        least = min((r.doc_id for r in members if r.doc_id is not None), default=None)
        assert {r.component_id for r in members} == {least}
    docs = make(rows)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(min((r.doc_id for r in got if r.doc_id is not None and int(r.fingerprint, 16) - (1 << 64) * (int(r.fingerprint, 16) >> 63) in c), default=None)) for c in classes)
    assert simhash.near_duplicates(make([])).count() == 0 and simhash.keep_representatives(make([])).count() == 0


def test_components_of_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(chain).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_matrix_has_exact_margins_and_the_right_law():
    counts, sizes = [5, 0, 7, 3, 9], sharding.even_sizes(24, 5)
    assert sizes == [5, 5, 5, 5, 4]
    draws = [sharding.communication_matrix(counts, sizes, s) for s in range(4000)]
    for m in draws[:200]:
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes
    first = np.array([m[4][0] for m in draws])  # 9 draws from 24 with 5 good
    assert abs(first.mean() - 9 * 5 / 24) < 0.06
    assert abs(first.var() - 9 * (5 / 24) * (19 / 24) * (15 / 23)) < 0.08


def check_plan(rows, shards, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shard_plan(make, spark):
    rows = [*ODD, *[(50, "same row")] * 300, *[(i, f"t{i}") for i in range(100, 400)]]
    got = sharding.shard_plan(make(rows), 7).collect()
    check_plan(got, 7, len(rows))
    size = {i: len((t or "").encode()) + 1 for i, t in ODD if i is not None}
    assert all(r.size == size[r.doc_id] for r in got if r.doc_id in size)
    assert len({r.shard for r in got if r.doc_id == 50}) == 7  # copies spread
    whole = sharding.shard(make(rows), 7)
    check_plan(whole.collect(), 7, len(rows))
    assert whole.select("row.*").columns == make(rows).columns
    assert sharding.shard_plan(make([]), 3).count() == 0


def test_shards_are_uniform(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    got = sharding.shard_plan(docs, 4, seed=3).toPandas().sort_values("doc_id")
    expected = np.full((4, 4), 250.0)
    quarter = got.doc_id // 1000
    table = np.array([[((quarter == q) & (got.shard == s)).sum() for s in range(4)] for q in range(4)])
    assert ((table - expected) ** 2 / expected).sum() < 30
    assert abs(np.corrcoef(got.doc_id, got.slot)[0, 1]) < 0.06


def test_plans_repeat(make):
    plan = partial(sharding.shard_plan, shards=3, seed=9)
    assert sorted(map(str, plan(make(ODD)).collect())) == sorted(map(str, plan(make(ODD).repartition(3)).collect()))
