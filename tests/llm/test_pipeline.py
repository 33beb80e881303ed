import corpus_pipeline
from brandsieve.llm import decontam, langid

from .test_dedup import lower
from .test_near_copies import brute_force, components_of, shingle_set


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)

    known = stages["language ID"](spark, docs, sf_dir)
    rejected = {r.doc_id for r in langid.identify(docs).where("rejected").collect()}
    left = [r for r in docs.collect() if r.doc_id not in rejected]
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in left}

    largest = {}
    for r in left:
        largest[lower(r.text)] = max(largest.get(lower(r.text), -1), r.doc_id)
    left = [r for r in left if largest[lower(r.text)] == r.doc_id]
    copies = stages["exact dedup"](spark, known, sf_dir)
    assert {r.doc_id for r in copies.collect()} == {r.doc_id for r in left}

    # masks find every pair within their radius, and nearly every one of 4/5 (test_near_copies measures that):
    # what stays beyond one text of each group has a near copy at the border, and equal sets never stay
    rows = [(r.doc_id, r.text) for r in left]
    kept, _ = brute_force(rows)
    near = stages["SimHash near-dedup"](spark, copies, sf_dir)
    got = {r.doc_id for r in near.collect()}
    of, _ = components_of(rows)
    group = {i: g for (i, _), g in zip(rows, of, strict=True)}
    sets = {i: shingle_set(t) for i, t in rows}
    assert kept <= got and len(got) <= 1.01 * len(kept)
    for extra in got - kept:
        others = [sets[i] for i in got - {extra} if group[i] == group[extra]]
        assert others and all(len(sets[extra] & o) < 0.9 * len(sets[extra] | o) for o in others)
    left = [r for r in left if r.doc_id in got]

    items = [decontam.normalise(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = stages["benchmark decontamination"](spark, near, sf_dir)
    gone = {r.doc_id for r in left} - {r.doc_id for r in clean.collect()}
    assert {r.doc_id for r in left if any(i in decontam.normalise(r.text) for i in items)} <= gone
    assert clean.columns == docs.columns

    encoded = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in encoded.collect()} == {r.doc_id for r in clean.collect()}
    assert encoded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_documents(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
