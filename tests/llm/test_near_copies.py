import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brandsieve.llm import near_copies, simhash

from .conftest import ODD


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    """One (doc_id, text) of each component of pairs with a Jaccard similarity of 4/5 and more."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return {min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values()}, len(groups)


@pytest.fixture(scope="module")
def rows(documents):
    rng = random.Random(4)
    found = [(r.doc_id, r.text) for r in documents.limit(80).collect()]
    top = max(i for i, _ in found)
    for n in range(120):  # copies of copies: groups, chains and pairs just out of reach
        words = (rng.choice(found)[1] or "").split()
        for _ in range(rng.randrange(1, 2 + len(words) // 12)):
            words[rng.randrange(len(words)) : 0] = [f"n{rng.randrange(30)}"] if words else []
        found.append((top + 1 + n, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(40))
    found += [(top + 200 + n, f"{passage} {' '.join(f'q{rng.randrange(9**6)}' for _ in range(n))}") for n in range(60)]
    return found + [(top + 300, None), (top + 301, " "), (top + 302, "two words"), (top + 303, "two  WORDS")]


def components_of(rows):
    """The component number of each row, by brute force."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = []
    for a, b in combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
            pairs.append((a, b))
    return [find(i) for i in range(len(rows))], pairs


@pytest.mark.parametrize(("large", "heads"), [(2048, 64), (6, 2)])
def test_links_against_brute_force(make, rows, large, heads):
    """No link joins texts of different components, and nearly every pair of near copies ends in one component."""
    docs = make(rows)
    body = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    each = near_copies._sets(docs, body)
    node = {r.doc_id: r.node for r in each.collect()}
    links = near_copies.linked(docs, body, each, large, heads).collect()
    true, pairs = components_of(rows)
    component = {node[i]: c for (i, _), c in zip(rows, true, strict=True)}
    assert all(component[r.a] == component[r.b] for r in links)
    root = {n: n for n in component}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for r in links:
        root[find(r.a)] = find(r.b)
    met = [find(node[rows[a][0]]) == find(node[rows[b][0]]) for a, b in pairs]
    assert len(pairs) > 60 and sum(met) >= 0.9 * len(met)


def test_stage_keeps_one_row_of_each_group(make, rows):
    docs = make(rows)
    got = near_copies.keep_representatives(docs)
    kept, groups = brute_force(rows)
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == docs.columns
    assert set(kept) <= set(ids)
    assert len(ids) == len(set(ids)) <= groups + 0.05 * (len(rows) - groups)


def test_odd_rows(make):
    got = near_copies.keep_representatives(make(ODD))
    kept, groups = brute_force(ODD)
    assert sorted(r.doc_id or 0 for r in got.collect()) == sorted(i or 0 for i in kept)
    assert got.count() == groups


def test_bits_are_counted_as_a_plain_loop_does():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 11, 12, 500):
        values = rng.integers(1 << 63, size=(n, 2), dtype=np.uint64) * np.uint64(2)
        plain = [sum(int(r[w]) >> b & 1 for r in values) for w in (0, 1) for b in range(64)]
        assert near_copies._ones(values).tolist() == plain


def test_masks_cover_every_pair_of_bits():
    for masks in near_copies._masks():
        assert len(masks) == 7
        for i, j in combinations(range(near_copies.BLOCK_BITS), 2):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)
        assert all(20 <= m.bit_count() <= 26 for m in masks)


def test_pipeline_stage_drops_copies_beyond_two_bits(spark, make):
    words = [f"w{i}" for i in range(90)]
    other = [*words[:40], "changed", *words[41:]]
    a, b = " ".join(words), " ".join(other)
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 2
    assert len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)) > 0.8
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    got = stage(spark, make([(1, a), (2, b), (3, "something else in so many words")]), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


@pytest.mark.parametrize("keep", [simhash.keep_representatives, near_copies.keep_representatives])
def test_different_texts_without_ids_stay(make, keep):
    texts = [" ".join(f"{k}{i}" for i in range(60)) for k in "abc"]
    got = keep(make([(None, t) for t in texts] + [(None, texts[0].upper()), (7, "one with an id")]))
    assert sorted(r.text.lower() for r in got.collect()) == sorted([*texts, "one with an id"])
    assert keep(make([])).count() == 0


def test_all_pairs_of_a_large_bucket_meet(spark):
    # 40 texts of 37 labels in one bucket and as many in another that fits; check words are within reach but for two
    rng = random.Random(5)
    texts = [(n, sum(1 << b for b in rng.sample(range(63), 6)), n if n > 4 else 0) for n in range(38)] + [(38, (1 << 62) - 1, 38), (39, -1, 39)]
    keyed = spark.createDataFrame([(key, *t) for key in (7, 8) for t in texts] + [(9, *t) for t in texts[:5]], "key long, node long, check long, label long")
    near = {(a[0], b[0]) for a, b in combinations(texts, 2) if a[2] != b[2] and ((a[1] ^ b[1]) & (2**64 - 1)).bit_count() <= near_copies.CHECK_BITS}
    for large in (7, 64):
        assert {tuple(r) for r in near_copies._exact_pairs(keyed, large).collect()} == near
    assert len(near) > 500


def test_cuts_change_no_link(spark):
    # texts of one passage: those off a forest, and those of parts far from each other, are compared as well
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for n in range(90):
        words = list(passage)
        for at in rng.sample(range(60), rng.randrange(1, 4)):
            words[at] = f"q{n % 9}"
        rows.append((n, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    body = F.xxhash64("text")
    each = near_copies._sets(docs, body).persist()
    groups = []
    for large, keep in ((4, 1), (4096, 64)):
        labels = near_copies.components(near_copies.linked(docs, body, each, large, keep))
        groups.append({(r.node, r.component) for r in labels.collect()})
    each.unpersist()
    assert groups[0] == groups[1]


def test_pairs_are_passed_on_as_they_are_found(spark, monkeypatch):
    """Texts of one bucket that are all alike give pairs in the square of their number; a task holds few of them."""
    monkeypatch.setattr(near_copies, "HELD_PAIRS", 500)
    rows = np.array([(1, n, 0, n) for n in range(100)], np.int64)
    everything = set(combinations(range(100), 2))
    for found in (near_copies._all_pairs(rows[:, 1:]), near_copies._small_pairs(rows)):
        sizes, pairs = [], set()
        for batch in near_copies._batches(found):
            sizes.append(batch.num_rows)
            pairs |= set(zip(*(batch.column(c).to_pylist() for c in "ab")))
        assert pairs == everything and max(sizes) < 600
