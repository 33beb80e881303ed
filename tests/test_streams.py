import datetime

import pytest

from brandsieve.session import build_session
from brandsieve.streaming import jobs


@pytest.fixture(scope="module")
def spark():
    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")


def test_old_certificates_of_new_hosts_are_seen(spark, tmp_path):
    schema = "raw_name string, not_before timestamp"
    day = datetime.datetime(2024, 5, 1)
    batches = [("a.com", 0), ("b.com", 9000)], [("a.com", 1), ("c.com", -400)], [("d.com", -3000), ("c.com", 5)]
    for rows in batches:  # one file each, in an order of their own
        spark.createDataFrame([(n, day + datetime.timedelta(d)) for n, d in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_first_sight(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    store = jobs.seen_store(spark, str(tmp_path / "out"))
    got = {r.domain: (r.not_before - day).days for r in jobs.seen_hosts(store).collect()}
    assert got == {"a.com": 0, "b.com": 9000, "c.com": -400, "d.com": -3000}
    assert store.version() == 2
