"""Structured Streaming forms of intake and funnel.

Hosts and findings live in keyed stores: a batch reads and writes the buckets its hosts fall into, and a batch
that is replayed after a lost driver changes nothing. The state of counts is bounded by watermarks.
Offsets live in the query's checkpoint location, on the cluster's shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brandsieve.functions.domains import normalize_domain
from brandsieve.operators.upsert import latest_per_key
from brandsieve.plans import funnel
from brandsieve.sources.keyed_store import KeyedStore

LATE_BY = "26 hours"
#: Buckets of a store; more of them let a batch leave more of a large store alone.
BUCKETS = 64


def hosts_of(certs: DataFrame) -> DataFrame:
    """Certificates with their host. No watermark: an old certificate may be the first of its host."""
    return certs.withColumn("domain", normalize_domain(F.col("raw_name")))


def day_counts(rows: DataFrame, at: str = "first_seen", late_by: str = LATE_BY) -> DataFrame:
    """Rows per UTC day."""
    return rows.withWatermark(at, late_by).groupBy(F.window(at, "1 day")).agg(F.count("*").alias("n"))


def brand_bursts(rows: DataFrame, brand: str, at: str = "first_seen", late_by: str = LATE_BY, at_least: int = 3) -> DataFrame:
    """Sliding seven-day counts per brand that reach ``at_least``; the batch window search stays exact."""
    return (
        rows.withWatermark(at, late_by)
        .groupBy(F.window(at, "7 days", "1 day"), brand)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= at_least)
    )


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> StreamingQuery:
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


SEEN = "domain string, not_before timestamp"


def seen_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(spark, path, SEEN, ["domain"], buckets)


def earliest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("domain").agg(F.min("not_before").alias("not_before"))


def seen_hosts(store: KeyedStore) -> DataFrame:
    """Every host that has been seen, with the earliest certificate time of all batches."""
    return earliest(store.read())


def news(known: DataFrame, hosts: DataFrame) -> DataFrame:
    """Hosts that are not known (``is_new``), and known ones with an earlier time than before."""
    before = earliest(known).select(F.col("domain").alias("_known"), F.col("not_before").alias("_before"))
    met = hosts.join(before, F.col("domain") == F.col("_known"), "left")
    earlier = (F.col("not_before") < F.col("_before")) | (F.col("_before").isNull() & F.col("not_before").isNotNull())
    return met.where(F.col("_known").isNull() | earlier).select("domain", "not_before", F.col("_known").isNull().alias("is_new"))


def run_first_sight(certs: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Hosts at first sight, batch by batch and in any order of their certificates, into a store of seen hosts.

    A host is added when it comes for the first time, and again only when a certificate turns up that is earlier
    than all before; nothing is kept as state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen_store(batch.sparkSession, path, buckets).append(earliest(batch.where(F.col("domain").isNotNull())), batch_id, news, earliest)

    return _run(hosts_of(certs), write, checkpoint, "append")


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changed rows of an aggregation, batch by batch; ``current`` reads the newest of each key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _run(stream, write, checkpoint, "update")


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows in force of what ``run_updates`` has written."""
    return latest_per_key(spark.read.option("basePath", path).parquet(path), keys, ["batch_id"]).drop("batch_id")


def findings_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(spark, path, funnel.FINDINGS, ["domain"], buckets)


def merged_findings(known: DataFrame, found: DataFrame) -> DataFrame:
    """``upsert_findings``, with the earliest first_seen of all batches that found the host."""
    looked = found.select("domain", F.col("first_seen").alias("looked"))
    rows = funnel.upsert_findings(known, found)
    return rows.join(looked, "domain", "left").withColumn("first_seen", F.least("first_seen", "looked")).drop("looked")


def once_for_all(tables: dict[str, DataFrame], path: str) -> list[DataFrame]:
    """The tables as files beside ``path``, so that a stream reads them in each batch and derives them once."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return [table.sparkSession.read.schema(table.schema).parquet(f"{path}/{name}") for name, table in tables.items()]


def run_funnel_stream(
    certs: DataFrame, watch: DataFrame, rdap: DataFrame, blacklist: DataFrame, probes: DataFrame, now: Column, path: str, checkpoint: str, buckets: int = BUCKETS,
) -> StreamingQuery:
    """The whole funnel on the hosts of each batch, upserted into the store of findings.

    Of the store only the buckets of hosts that the batch found are read and written. A host that comes back takes
    a new look and updates its finding. The watchlist and the snapshots are those at the start of the run.
    """
    watch, rdap, blacklist, probes = once_for_all({"watch": watch, "rdap": rdap, "blacklist": blacklist, "probes": probes}, f"{path}-snapshots")

    def write(batch: DataFrame, batch_id: int) -> None:
        hosts = batch.groupBy("domain").agg(F.min("seen_at").alias("first_seen"), F.min("not_before").alias("not_before"))
        found = funnel.findings(funnel.run_funnel(hosts, watch, rdap, blacklist, probes, now), now)
        findings_store(batch.sparkSession, path, buckets).rewrite(found, batch_id, merged_findings)

    return _run(hosts_of(certs), write, checkpoint, "append")
