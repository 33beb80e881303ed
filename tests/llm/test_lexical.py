import math
import random
import re
from collections import Counter

import pytest

from brandsieve.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for name, text in items:
        scores = []
        for doc, c, n in counts:
            m = 100 - 50 + 50 * n * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(name, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark, make):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Été", "été", "naïve", "x_y", "a-b", "日本", "42"]
    text = lambda most: " ".join(rng.choice(words[: rng.randrange(5, len(words))]) for _ in range(rng.randrange(most)))
    docs = [(i, text(40)) for i in range(300)] + [(None, "w1 w2"), (None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2"), (900, None), (901, ""), (902, "!!"), (903, "W1" + " w50" * 50_000)]
    items = [(i, text(25)) for i in range(90)] + [(3, "w1 W1 w2"), (None, "w5"), (91, None), (92, ""), (93, "unknown"), (94, "w59,w58;WORD")]
    schema = "item_id long, text string, doc_id long, score long, block int"
    return docs, items, make(docs), spark.createDataFrame([(*x, 1, 2, 3) for x in items], schema)


@pytest.mark.parametrize(("top", "block_docs", "owners"), [(50, 4096, 4), (5, 16, 6), (3, 50, 1)])
def test_search_matches_brute_force(tables, top, block_docs, owners):
    docs, items, docs_df, items_df = tables
    assert found(lexical.search(docs_df, items_df, top, block_docs, owners)) == brute_force(docs, items, top)


def test_blocks_of_items_change_nothing(tables, monkeypatch):
    docs, items, docs_df, items_df = tables
    monkeypatch.setattr(lexical, "VOCABULARY", 40)
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", 3)
    assert found(lexical.search(docs_df, items_df.where("item_id < 12"), 10)) == brute_force(docs, [x for x in items if x[0] is not None and x[0] < 12], 10)


def test_empty_tables(spark, make):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(make([]), items).count() == 0
    assert lexical.search(make([(1, None)]), items).count() == 0
    none = lexical.search(make([(1, "a")]), items.where("false"))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0
