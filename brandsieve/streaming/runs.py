"""Collector runs: one batch of certificates into the store of seen hosts, and one row of the run log.

What a run fetched and inserted is observed while its data passes, so the log costs no scan of its own.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brandsieve.functions.domains import normalize_domain
from brandsieve.sources.keyed_store import KeyedStore
from brandsieve.streaming import jobs

LOG = (
    "started_at timestamp, finished_at timestamp, source string, fetched long, inserted_new long, status string, error_message string"
)
OK, PARTIAL, FAILED = "ok", "partial", "failed"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def collect(certs: DataFrame, store: KeyedStore, version: int, log: str, source: str, complete: bool = True) -> str:
    """Put ``certs`` (raw_name, not_before) into ``store`` as its batch ``version`` and add a row to the run log; the status.

    ``complete`` is False if the source stopped early: what came is kept and the run is partial. A run that
    fails is logged with its error and what it had fetched by then; its batch may be tried again.
    """
    spark = certs.sparkSession
    started = datetime.datetime.now(datetime.timezone.utc)
    came, went = Observation(), Observation()
    hosts = certs.select(normalize_domain(F.col("raw_name")).alias("domain"), "not_before").observe(came, F.count(F.lit(1)).alias("fetched"))
    hosts = hosts.where(F.col("domain").isNotNull() & (F.col("domain") != "")).groupBy("domain").agg(F.min("not_before").alias("not_before"))

    def added(known: DataFrame, batch: DataFrame) -> DataFrame:
        return jobs.news(known, batch).observe(went, F.count_if("is_new").alias("inserted"))

    error = None
    try:
        wrote = store.append(hosts, version, added, jobs.earliest)
        status = OK if complete else PARTIAL
        fetched, inserted = (came.get["fetched"], went.get["inserted"]) if wrote else (0, 0)
    except Exception as failure:  # noqa: BLE001  whatever it was, the log says so
        status, error, fetched, inserted = FAILED, str(failure).partition("\n")[0][:500], 0, 0
    finished = datetime.datetime.now(datetime.timezone.utc)
    row = [(started, finished, source, fetched, inserted, status, error)]
    spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(log)
    return status
