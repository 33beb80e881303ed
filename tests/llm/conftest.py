from pathlib import Path

import pytest
from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, digest string, row string, fp long, key long"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(Path(tmp_path_factory.mktemp("shared")).as_uri())
    return session


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names the operators use inside, from (doc_id, text[, lang])."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, "d", "r", 1, None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "A lone row"), (None, "a lone ROW"), (4, "same Text"), (5, "SAME text"),
    (6, "SAME text"), (6, "SAME text"), (7, "Énorme ÄÖ"), (8, "énorme äö"), (9, "x" * 300_000), (10, "word " * 60_000), (11, "42 !"),
]
