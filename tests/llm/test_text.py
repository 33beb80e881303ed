import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from brandsieve.llm import bpe, chars, decontam, langid, licenses, quality, secrets, toxicity
from brandsieve.llm.queries import tokenizer_path

from .conftest import ODD


@pytest.fixture(scope="module")
def tokenizer():
    with open(tokenizer_path(), "rb") as file:
        return bpe.ByteBpe(file.read())


def strange_texts():
    rng = random.Random(4)
    letters = "aA zZ\t\n\r\x1c​ é'ßçñ中文日本한국👍🏽²½ⅣΩ!!..<|endoftext|>'s're`_-0123\x00՘౜"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return texts + ["", "a" * 3000, " " * 500, "the" * 400, "<|endoftext|><|endoftext|>x", "=-" * 200, "x" * 48, "x" * 49, "é" * 24]


def test_bpe_equals_the_library(tokenizer, documents):
    library = Tokenizer.from_file(tokenizer_path())
    texts = strange_texts() + [r.text for r in documents.collect()]
    for text, ids in zip(texts, tokenizer.encode_batch(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert tokenizer.decode(expected) == library.decode(expected, skip_special_tokens=False)


def test_bpe_short_and_long_paths_agree(tokenizer):
    for word in ("Ġ", "tokenization", "aaaaaaaaab", "Überraschung", "0123456789"):
        data = word.encode()
        assert tokenizer._scan(np.frombuffer(data, np.uint8).reshape(1, -1))[0] == tokenizer._heap(data)


def test_bpe_decodes_broken_utf8_as_the_library_does(tokenizer):
    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert tokenizer.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_frames(make):
    got = bpe.encode(make(ODD), tokenizer_path())
    assert sorted(r.decoded for r in got.collect()) == sorted(t or "" for _, t in ODD)
    first = {r.doc_id: r for r in bpe.digests(got).collect()}
    assert first[1].n_tokens == 0 and first[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(make([]), tokenizer_path()).count() == 0


def slow_distance(pattern, text):
    """Least edits of ``pattern`` to a substring of ``text``, and the first end."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for at, c in enumerate(text):
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], at + 1)
    return best


def test_myers_and_pigeonhole_against_dynamic_programming():
    rng = random.Random(8)
    items = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(20, 90))).strip()) for i in range(25)]
    matcher = decontam.Matcher(items, 0.1)
    hits = 0
    for _ in range(120):
        name, item = rng.choice(items)
        edited = list(item)
        for _ in range(rng.randint(0, len(item) // 6)):
            k = rng.randrange(len(edited))
            edited[k : k + 1] = rng.choice([[], [rng.choice("abcde")], [edited[k], "a"]])
            edited = edited or ["a"]
        text = "".join(rng.choice("abcd ") for _ in range(40)) + "".join(edited) + "".join(rng.choice("abcd ") for _ in range(40))
        expected = {}
        for i, t in items:
            d, end = slow_distance(t, text)
            if d <= int(len(t) * 0.1):
                expected[i] = (d, end)
        found = {i: (d, end) for i, d, _, _, end in matcher.find(text)}
        assert found == expected
        for i, d, _, start, end in matcher.find(text):
            assert slow_distance(dict(items)[i], text[start:end])[0] == d
        hits += len(found)
    assert hits > 40


def test_items_that_share_an_id_keep_their_budgets(make, spark):
    long, short = "a fairly long item of the benchmark that allows for some errors in all of its words", "twenty-six letters in here."
    items = spark.createDataFrame([(1, long), (1, short), (None, short)], "item_id long, text string")
    got = decontam.matches(make([(5, f"{long} and {short}")]), items).collect()
    assert sorted((r.item_id or 0, r.budget) for r in got) == sorted([(1, int(len(long) * 0.08)), (1, int(len(short) * 0.08)), (0, int(len(short) * 0.08))])


def test_decontamination_frames(make, spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog tonight"), (2, None), (3, ""), (4, "the QUICK brown fox  jumps over the lazy dog tonight")], "item_id long, text string")
    leak = "Before.\n The  quick brown fox jumped over the lazy dog tonight, after."
    docs = make([*ODD, (30, leak), (30, leak), (31, "nothing of that")])
    got = decontam.matches(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(30, 1), (30, 1), (30, 4), (30, 4)]
    assert {leak[r.start : r.end] for r in got} == {"The  quick brown fox jumped over the lazy dog tonight"}
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in [*[i for i, _ in ODD], 31])
    assert decontam.matches(make([]), items).count() == 0
    assert decontam.matches(docs, items.limit(0)).count() == 0
    assert decontam.decontaminate(docs, items.limit(0)).count() == docs.count()


def test_items_in_several_blocks(make, spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 60)
    items = spark.createDataFrame([(i, f"item number {i} with words of its own like w{i * 37} and v{i * 91}") for i in range(6)], "item_id long, text string")
    texts = {r.item_id: r.text for r in items.collect()}
    docs = make([(i, f"so: {t}.") for i, t in texts.items()])
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).where("distance = 0").collect()} == {(i, i) for i in texts}
    assert decontam.decontaminate(docs, items).count() == 0


def test_subwords_and_words_against_plain_python(monkeypatch):
    monkeypatch.setattr(chars, "PIECE", 16)
    chars._powers.cache_clear()
    text = "Déjà vu, 12 times: the naïve THE cat's hat — the end ofaverylongwordindeed"
    got = np.concatenate(list(chars.words(text.replace("ofaverylongwordindeed", "of"), 40)))
    plain = "déjà vu times the naïve the cat s hat the end of".split()
    assert len(got) == len(plain) and len(set(got.tolist())) == len(set(plain))
    grams = np.concatenate(list(chars.subwords("ab c", 30, (1, 2, 3))))
    assert len(grams) == 3 + 5 + 3  # a b c; _a ab b_ _c c_; _ab ab_ _c_
    monkeypatch.undo()
    chars._powers.cache_clear()


def test_language_id_on_rows_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.01


def test_language_id_frames(make):
    rows = [(i, "the cat and the dog were here with that", "en") for i in range(100, 140)] + [(i, "le chat et les chiens sont dans une maison", "fr") for i in range(200, 240)]
    docs = make([*rows, *ODD])
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[101].lang_pred == "en" and got[201].lang_pred == "fr"
    for blank in (1, 2, 3, 11):  # null, empty, spaces; "42 !" has no letter
        if blank != 11:
            assert (got[blank].lang_pred, got[blank].score, got[blank].rejected) == ("und", 0.0, True)
    assert got[11].lang_pred == "und"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {101, 201} <= {r.doc_id for r in kept.collect()}
    assert langid.identify(make([])).count() == 0
    assert {r.lang_pred for r in langid.identify(make(ODD)).collect()} == {"und"}


def test_toxicity_on_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    known = labels.where("doc_id % 5 = 0")
    got = toxicity.score(docs.join(known.select("doc_id"), "doc_id"), chain).join(known.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    assert got[got.label == 0].toxic.mean() < 0.005
    assert got[got.label == 1].toxic.mean() > 0.75
    assert list(got.columns[:5]) == ["doc_id", "p_insult", "p_contempt", "p_toxic", "toxic"]


def test_toxicity_frames(make, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 160)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    docs = make([*ODD, *[(i, f"you idiot number {i}" if i % 2 else f"kind words number {i}") for i in range(100, 160)]])
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i].toxic == bool(i % 2) for i in range(100, 160)) and not got[1].toxic
    empty = toxicity.train(docs, labels.limit(0))
    assert {r.p_toxic for r in toxicity.score(docs, empty).collect()} == {0.5}
    assert toxicity.score(make([]), empty).count() == 0


def test_out_of_fold_inputs_differ_from_fits():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(200)]
    labels = np.column_stack([[int(3 in r) for r in rows], [int(3 in r or 5 in r) for r in rows]])
    chain = toxicity.fit_chain(["a", "b"], rows, labels, np.arange(200) % 4)
    assert len(chain.links[1].weights) == len(chain.links[1].features) + 2  # the category before and the constant
    assert chain.links[1].weights[-2] > 0.5


def test_label_model_recovers_planted_accuracies():
    rng, counts = np.random.default_rng(3), {}
    truth = rng.random(20_000) > 0.25
    for good in truth:
        kind = rng.integers(0, len(quality.LABELLERS))
        vote = [quality.BAD if (not good and k == kind and rng.random() < 0.95) or rng.random() < 0.001 else quality.GOOD for k in range(len(quality.LABELLERS))]
        key = (tuple(vote), bool(good))
        counts[key] = counts.get(key, 0) + 1
    patterns = {}
    for (p, _), n in counts.items():
        patterns[p] = patterns.get(p, 0) + n
    posterior, shares = quality.label_model(patterns)
    right = sum(n for (p, good), n in counts.items() if (posterior[p] >= 0.5) == good)
    assert right / 20_000 > 0.97
    assert (shares[:, 0] < 0.005).all() and (np.diag(shares[:, 1:]) >= 0.9).all()
    assert quality.label_model({})[0] == {}


def test_planted_accuracies_come_back():
    rng, planted = np.random.default_rng(3), np.array([0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])
    good = rng.random(20000) < 0.75
    right = rng.random((20000, len(planted))) < planted
    votes = np.where(right == good[:, None], quality.GOOD, quality.BAD)
    patterns = Counter(map(tuple, votes.tolist()))
    posterior, shares = quality.label_model(patterns)
    assert shares.shape == (7, 2)
    assert np.abs(shares[:, 0] - (1 - planted)).max() < 0.03 and np.abs(shares[:, 1] - planted).max() < 0.03
    mean = sum(posterior[p] * c for p, c in patterns.items()) / 20000
    assert abs(mean - 0.75) < 0.02


def test_quality_against_labels_never_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs).join(labels, "doc_id").toPandas()
    assert (got.good == (got.quality == 1)).mean() > 0.97
    assert got[got.quality == 1].good.mean() > 0.98


def test_quality_frames(make):
    got = quality.classify(make(ODD)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(make([])).count() == 0


def test_licences_by_canonical_digest(make):
    mit = licenses.KNOWN["MIT"][0]
    rows = [
        *ODD,
        (40, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,").replace("\n\n", "\n \n")),
        (41, "some prose\nreleased under the  mit LICENCE\nmore prose"),
        (42, "this is released under the MIT License. And more"),
        (43, "x\n\n" + licenses.KNOWN["Apache-2.0"][0].replace("\n\n", " ") + "\n\ny"),
        (44, "Licensed under CC BY-NC 4.0.\nLicensed under CC-BY-NC 4.0\nLicensed under CC BY 4.0"),
    ]
    got = {(r.doc_id, r.license): (r.unit, r.places, r.restricted) for r in licenses.find(make(rows)).collect()}
    assert got == {
        (40, "MIT"): ("text", 1, False),
        (41, "MIT"): ("line", 1, False),
        (43, "Apache-2.0"): ("paragraph", 1, False),
        (44, "CC-BY-NC-4.0"): ("line", 2, True),
        (44, "CC-BY-4.0"): ("line", 1, False),
    }
    assert licenses.find(make([])).count() == 0


def test_licences_against_brute_force(documents):
    import re

    known = {" ".join(re.findall(r"[^\W_]+", t.lower())): name for name, texts in licenses.KNOWN.items() for t in texts}
    expected = set()
    for r in documents.collect():
        for unit in [r.text, *re.split(r"\n\s*\n", r.text), *r.text.split("\n")]:
            name = known.get(" ".join(re.findall(r"[^\W_]+", unit.lower())))
            if name:
                expected.add((r.doc_id, name))
    assert {(r.doc_id, r.license) for r in licenses.find(documents).collect()} == expected and expected


def test_secret_candidates_and_places(make):
    text = 'see token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and password: "hunter2345" or internationalizationandmore, thisisaquitelongword'
    got = {r.value: r for r in secrets.candidates(make([*ODD, (60, text)])).where("doc_id = 60").collect()}
    assert set(got) == {"04dbebab91ab85687d33eeaaf9ac699e1188f962", "hunter2345", "internationalizationandmore", "thisisaquitelongword"}
    assert all(text[r.start : r.start + len(v)] == v for v, r in got.items())
    assert got["hunter2345"].before.endswith('password: "')


def test_secret_forest(make):
    rows = [*ODD, (60, 'key: token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'), (61, "commit 3f2a9c1d7b5e8f6a4c0d2e1b9a8f7c6d5e4b3a21 fixes it"), (62, "the internationalizationandlocalization of things")]
    got = {r.doc_id: r for r in secrets.scan(make(rows)).collect()}
    assert got[60].secret and not got[61].secret and not got[62].secret
    assert secrets.scan(make([])).count() == 0


def test_secrets_planted_in_documents(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = {(r.doc_id, m.start(1)) for r in docs.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text)}
    got = {(r.doc_id, r.start) for r in secrets.scan(docs).where("secret").collect()}
    assert expected <= got and len(got - expected) <= len(expected) * 0.2 and json.dumps(len(expected)) != "0"
