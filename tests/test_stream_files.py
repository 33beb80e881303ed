"""The files that a stream of certificates lands in do not grow with the tables."""

import pyarrow.parquet as pq

from brandsieve.session import build_session
from catalog import streams
from catalog.registry import Inputs


def test_more_certificates_make_more_files(tmp_path, monkeypatch):
    spark = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")
    inputs = Inputs(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(streams, "_folder", lambda i, name: str(tmp_path / name))
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 200)
    stream = streams._cert_stream(inputs)
    rows = [pq.ParquetFile(f).metadata.num_rows for f in (tmp_path / "cert").glob("*.parquet")]
    assert stream.isStreaming and sum(rows) == inputs.cert.count() > 20 * 200
    assert max(rows) < 4 * 200
