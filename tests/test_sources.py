"""File readers, tables by day and the run log, on small files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brandsieve.operators.brand_match import find_similar
from brandsieve.session import build_session
from brandsieve.sources import ct, dated, snapshots
from brandsieve.sources.keyed_store import KeyedStore
from brandsieve.streaming import jobs, runs


@pytest.fixture(scope="module")
def spark():
    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")


HEADER = "brand_name,aliases,official_domain,category,match_mode,source\n"


def test_watchlist_files_keep_their_order(spark, tmp_path):
    for name, first in (("a.csv", 0), ("b.csv", 40)):
        lines = [f'Brand {n},"kata{n};sama",brand{n}.co.id,bank,edit_distance,x' for n in range(first, first + 40)]
        (tmp_path / name).write_text(HEADER + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")  # files are cut
    try:
        watch = snapshots.read_watchlist(spark, str(tmp_path))
        assert watch.rdd.getNumPartitions() == 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert {r.brand_name: r.brand_idx for r in watch.collect()} == {f"Brand {n}": n for n in range(80)}
        tied = find_similar(spark.createDataFrame([("sama.xyz",)], "domain string"), watch).first()
        assert tied.matched_brand == "Brand 0"  # equal hits go to the first of the list
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_corrupt_lines_are_told(spark, tmp_path):
    (tmp_path / "w.csv").write_text(HEADER + "Kita Bank,KB,kita.co.id,bank,edit_distance,x\nonly one field\n")
    rows = {r.brand_name: r._corrupt for r in snapshots.read_watchlist(spark, str(tmp_path)).collect()}
    assert rows["Kita Bank"] is None and rows["only one field"] == "only one field"


def test_json_readers(spark, tmp_path):
    sample = {"id": "1", "type": "message", "content": "hi", "label": "legit", "category": "c", "source": "s"}
    (tmp_path / "l.jsonl").write_text(json.dumps(sample) + "\n")
    assert snapshots.read_labelled(spark, str(tmp_path / "l.jsonl")).first().asDict() == sample
    page = {"rows": [{"id": "7", "match": "*.A.test", "not_before": "2024-01-02T00:00:00Z", "san_count": 1}], "has_next": False}
    (tmp_path / "p.jsonl").write_text(json.dumps(page) + "\n")
    got = ct.ct_rows(ct.read_ct_pages(spark, str(tmp_path / "p.jsonl")), F.lit("2024-01-01").cast("timestamp")).first()
    assert got.domain == "a.test" and got.not_before == datetime.datetime(2024, 1, 2)
    tables = {"daily": spark.createDataFrame([("2024-01-01", 3)], "date string, n long")}
    snapshots.write_snapshot(tables, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap/daily")).first().n == 3
    (tmp_path / "dump.json").write_text(json.dumps({"runs": [{"id": 1, "status": "ok"}, {"id": 2, "status": "failed"}]}, indent=1))
    assert [r.status for r in snapshots.read_snapshot(spark, str(tmp_path / "dump.json"), "runs", "id: LONG, status: STRING").collect()] == ["ok", "failed"]
    snapshots.write_findings_csv(tables["daily"], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().asDict() == {"date": "2024-01-01", "n": "3"}


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampType())])


def hours(spark, first, count):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(n, start + datetime.timedelta(hours=n)) for n in range(first, first + count)], SCHEMA)


def test_days_are_pruned_and_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    dated.write_days(hours(spark, 0, 240), path, "at")
    assert dated.days(spark, path) == [f"2024-01-{d:02}" for d in range(1, 11)]
    one = dated.read_days(spark, path, SCHEMA, "2024-01-03", "2024-01-03")
    assert sorted(r.id for r in one.collect()) == list(range(48, 72))
    assert all("day=2024-01-03" in f for f in one.where("id > 50").inputFiles()) or "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()
    scan = [x for x in one._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x]
    assert scan and "2024-01-03" in scan[0].partition("PartitionFilters")[2].partition("PushedFilters")[0]
    dated.write_days(hours(spark, 48, 5), path, "at")  # the third day once more, with fewer rows
    assert dated.read_days(spark, path, SCHEMA).count() == 240 - 24 + 5


def test_retention_drops_days_and_filters_the_border(spark, tmp_path):
    path = str(tmp_path / "t")
    dated.write_days(hours(spark, 0, 240), path, "at")
    cutoff = "2024-01-04 06:00:00"
    expected = hours(spark, 0, 240).where(F.col("at") < F.lit(cutoff).cast("timestamp")).count()
    assert dated.drop_before(spark, path, SCHEMA, "at", cutoff) == expected == 78
    assert dated.days(spark, path)[0] == "2024-01-04"
    assert sorted(r.id for r in dated.read_days(spark, path, SCHEMA).collect()) == list(range(78, 240))
    assert dated.drop_before(spark, path, SCHEMA, "at", cutoff) == 0
    assert dated.drop_before(spark, path, SCHEMA, "at", "2024-01-04 23:30:00") == 18
    assert dated.days(spark, path)[0] == "2024-01-05"


def test_runs_are_logged(spark, tmp_path):
    store, log = jobs.seen_store(spark, str(tmp_path / "s"), 4), str(tmp_path / "log")
    day = datetime.datetime(2024, 1, 1)
    certs = lambda *names: spark.createDataFrame([(n, day) for n in names], "raw_name string, not_before timestamp")
    assert runs.collect(certs("*.a.com", "a.com", "b.com"), store, 0, log, "x") == runs.OK
    assert runs.collect(certs("b.com", "c.com"), store, 1, log, "x", complete=False) == runs.PARTIAL
    broken = certs("d.com").withColumn("raw_name", F.raise_error(F.lit("source broke")).cast("string"))
    assert runs.collect(broken, store, 2, log, "y") == runs.FAILED
    assert runs.collect(certs("d.com"), store, 2, log, "y") == runs.OK
    rows = runs.read_log(spark, log).orderBy("started_at").collect()
    assert [(r.source, r.fetched, r.inserted_new, r.status) for r in rows] == [("x", 3, 2, "ok"), ("x", 2, 1, "partial"), ("y", 0, 0, "failed"), ("y", 1, 1, "ok")]
    assert "source broke" in rows[2].error_message and all(r.finished_at >= r.started_at for r in rows)
    assert sorted(r.domain for r in jobs.seen_hosts(store).collect()) == ["a.com", "b.com", "c.com", "d.com"]
    assert isinstance(store, KeyedStore)
