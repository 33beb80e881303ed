"""A funnel stream lands the columns that its batches read, and no others."""

from brandsieve.session import build_session
from catalog import streams
from catalog.registry import Inputs


def test_streams_land_what_they_read(monkeypatch, tmp_path):
    spark = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")
    came = {}
    monkeypatch.setattr(streams, "_folder", lambda i, name: str(tmp_path / name))
    monkeypatch.setattr(streams.jobs, "run_funnel_stream", lambda certs, watch, *tables: came.update(certs=certs, tables=tables[:3]))
    monkeypatch.setattr(streams.jobs, "findings_store", lambda *_: came["store"])
    monkeypatch.setattr(streams, "dated", lambda rows: rows)
    came["store"] = type("Store", (), {"read": lambda self: None})()
    streams.t4(Inputs(spark, "/root/testdata/sf0.001"))
    assert sorted(came["certs"].columns) == ["not_before", "raw_name", "seen_at"]
    assert not any(c.startswith("seq") for table in came["tables"] for c in table.columns)
    assert spark.read.parquet(str(tmp_path / "cert")).columns == came["certs"].columns
