import datetime
import random

import pytest
from pyspark.sql import functions as F

from brandsieve.operators.upsert import upsert
from brandsieve.session import build_session
from brandsieve.sources import files, keyed_store
from brandsieve.sources.keyed_store import KeyedStore
from brandsieve.streaming import jobs

SCHEMA = "k string, first long, last long"


@pytest.fixture(scope="module")
def spark():
    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")


def batch(spark, rows):
    return spark.createDataFrame([(k, v, v) for k, v in rows], SCHEMA)


def merge(known, new):
    return upsert(known, new, ["k"], ["last"])


def content(store):
    return {r.k: (r.first, r.last) for r in store.read().collect()}


def test_rewrite_equals_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    store, expected = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 8), {}
    for version in range(5):
        rows = list({f"k{rng.randrange(40)}": 100 * version + n for n in range(12)}.items())
        assert store.rewrite(batch(spark, rows), version, merge)
        expected.update({k: (expected.get(k, (v,))[0], v) for k, v in rows})
        assert content(store) == expected
        assert not store.rewrite(batch(spark, [("other", 1)]), version, merge)  # a replay
        assert content(store) == expected
    lists = files.names(spark, f"{tmp_path}/s/versions")
    assert lists == ["3", "4"]
    held = {f"version={v}" for n in lists for vs in store._list(int(n)).values() for v in vs}
    assert set(files.names(spark, f"{tmp_path}/s/data")) == held


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 16)
    store.rewrite(batch(spark, [(f"k{n}", n) for n in range(200)]), 0, merge)
    new = batch(spark, [("k7", 1000)])
    (one,) = store.touched(new)
    seen = []

    def watching(known, found):
        seen.extend(known.inputFiles())
        return merge(known, found)

    store.rewrite(new, 1, watching)
    assert seen and all(f"bucket={one}/" in f for f in seen)
    assert files.names(spark, f"{tmp_path}/s/data/version=1") == ["_SUCCESS", f"bucket={one}"]
    assert content(store)["k7"] == (7, 1000) and len(content(store)) == 200


def test_a_batch_cut_off_before_its_list_is_done_again(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 4)
    store.rewrite(batch(spark, [("a", 1), ("b", 2)]), 0, merge)
    store.rewrite(batch(spark, [("a", 5)]), 1, merge)
    files.remove(spark, f"{tmp_path}/s/versions/1")  # as if the driver was lost there
    assert content(store) == {"a": (1, 1), "b": (2, 2)}
    assert store.rewrite(batch(spark, [("a", 5)]), 1, merge)
    assert content(store) == {"a": (1, 5), "b": (2, 2)}


def test_empty_store_and_batch(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 4)
    assert store.version() is None and store.read().count() == 0
    assert store.rewrite(batch(spark, []), 0, merge)
    assert store.version() == 0 and store.read().count() == 0 and store.read().columns == ["k", "first", "last"]


def test_full_buckets_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_store, "MOST_VERSIONS", 3)
    day = datetime.datetime(2024, 1, 1)
    rows = lambda names, n: spark.createDataFrame([(x, day + datetime.timedelta(n)) for x in names], jobs.SEEN)
    store = jobs.seen_store(spark, str(tmp_path / "s"), 2)
    for version in range(9):
        assert store.append(rows([f"h{version}", "a", "b"], -version), version, jobs.news, jobs.earliest)
        assert all(len(v) <= 4 for v in store._list(version).values())
    got = {r.domain: r.not_before for r in jobs.seen_hosts(store).collect()}
    assert got == {**{f"h{n}": day - datetime.timedelta(n) for n in range(9)}, "a": day - datetime.timedelta(8), "b": day - datetime.timedelta(8)}


def test_first_sight_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(9)
    day = datetime.datetime(2024, 5, 1)
    rows = [(rng.choice(["*.", "", " "]) + f"h{rng.randrange(60)}.com", day + datetime.timedelta(hours=rng.randrange(-9000, 9000))) for _ in range(300)]
    schema = "raw_name string, not_before timestamp"
    for at in range(0, 300, 60):  # one file each, in an order of their own
        spark.createDataFrame(rows[at : at + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.run_first_sight(stream, out, str(tmp_path / "ckpt"), buckets=8)
    store = jobs.seen_store(spark, out, 8)
    whole = jobs.earliest(jobs.hosts_of(spark.createDataFrame(rows, schema)))
    assert sorted(map(tuple, jobs.seen_hosts(store).collect())) == sorted(map(tuple, whole.collect()))
    assert store.version() == 4
    # the whole stream once more, as new batches: nothing is added
    before = store.read().count()
    jobs.run_first_sight(stream, out, str(tmp_path / "ckpt2"), buckets=8)  # batch ids that are in
    assert store.read().count() == before
    store.append(whole, 5, jobs.news, jobs.earliest)
    assert store.read().count() == before


def test_null_names_and_times(spark, tmp_path):
    store = jobs.seen_store(spark, str(tmp_path / "s"), 4)
    rows = spark.createDataFrame([("a.com", None), ("b.com", datetime.datetime(2024, 1, 1))], jobs.SEEN)
    store.append(rows, 0, jobs.news, jobs.earliest)
    store.append(rows.withColumn("not_before", F.lit("2023-01-01").cast("timestamp")), 1, jobs.news, jobs.earliest)
    got = {r.domain: r.not_before.year for r in jobs.seen_hosts(store).collect()}
    assert got == {"a.com": 2023, "b.com": 2023}
