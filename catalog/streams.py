"""Streaming queries T1-T4, each run over what has landed and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brandsieve.sources import dated as dated_tables
from brandsieve.streaming import jobs, runs
from catalog.funnel import FINDINGS_SQL, ISO, SEQ, STAGES, blacklist, dated, now, probe, rdap
from catalog.landing import shared_folder
from catalog.registry import Inputs, query


#: A stream of certificates comes in three batches: FILES files at least, and FILES_PER_BATCH of every FILES in a batch.
FILES, FILES_PER_BATCH = 8, 3
#: Certificates in a file, about 50 MB; more of them make more files, not larger ones.
ROWS_PER_FILE = 1 << 19


def _folder(i: Inputs, name: str) -> str:
    return f"{shared_folder(i.spark)}/{name}-{uuid.uuid4().hex}"


def _cert_stream(i: Inputs, *columns: str):
    """Certificates as they land: a table of several files, read a few files per batch; with ``columns`` if a stream reads no others."""
    path = _folder(i, "cert")
    rows = i.lineitem.count() + i.pages.count()  # as the view has them; both counts come from the files' footers
    files = max(FILES, -(-rows // ROWS_PER_FILE))
    certs = i.cert.select(*columns or i.cert.columns)
    certs.repartition(files, F.xxhash64("raw_name")).write.parquet(path)
    return i.spark.readStream.schema(certs.schema).option("maxFilesPerTrigger", -(-files * FILES_PER_BATCH // FILES)).parquet(path)


def _event_stream(i: Inputs):
    stream = i.spark.readStream.schema(i.events.schema).option("pathGlobFilter", "events.parquet").parquet(i.sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_first_sight_stream", "SELECT host AS domain, strftime(min(not_before), '%Y-%m-%d %H:%M:%S') AS not_before FROM cert GROUP BY host")
def t1(i: Inputs):
    """Hosts of several batches in the store of seen hosts, each with its earliest certificate."""
    out = _folder(i, "t1")
    jobs.run_first_sight(_cert_stream(i, "raw_name", "not_before"), out, out + "-ckpt")
    return jobs.seen_hosts(jobs.seen_store(i.spark, out)).withColumn("not_before", F.date_format("not_before", ISO))


@query("t2_day_counts_stream", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1")
def t2(i: Inputs):
    out = _folder(i, "t2")
    jobs.run_updates(jobs.day_counts(_event_stream(i), "ts"), out, out + "-ckpt")
    return jobs.current(i.spark, out, ["window"]).select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "n")


@query(
    "t3_burst_stream",
    """SELECT strftime(day - to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS window_start, event_type, CAST(sum(n) AS BIGINT) AS n
       FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) e, (SELECT unnest(range(7)) AS k) ks GROUP BY ALL HAVING sum(n) >= 3""",
)
def t3(i: Inputs):
    out = _folder(i, "t3")
    jobs.run_updates(jobs.brand_bursts(_event_stream(i), "event_type", "ts"), out, out + "-ckpt")
    rows = jobs.current(i.spark, out, ["window", "event_type"])
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("window_start"), "event_type", "n")


@query("t4_matching_stream", FINDINGS_SQL, STAGES)
def t4(i: Inputs):
    """The funnel batch by batch: several batches, hosts that come back, one table."""
    out = _folder(i, "t4")
    snapshots = [t.drop(*SEQ) for t in (rdap(i), blacklist(i), probe(i))]  # what orders the looks at a host has done its part
    jobs.run_funnel_stream(_cert_stream(i, "raw_name", "seen_at", "not_before"), i.watch, *snapshots, now(), out, out + "-ckpt")
    return dated(jobs.findings_store(i.spark, out).read())


_BORDER = "1999-01-01 00:00:00"


@query(
    "w13_collector_log",
    f"""SELECT 'earlier' AS source, count(*) AS fetched, count(DISTINCT host) AS inserted_new, 'ok' AS status FROM cert WHERE not_before < TIMESTAMP '{_BORDER}'
        UNION ALL SELECT 'later', count(*), count(DISTINCT CASE WHEN host NOT IN (SELECT host FROM cert WHERE not_before < TIMESTAMP '{_BORDER}') THEN host END), 'partial'
        FROM cert WHERE not_before >= TIMESTAMP '{_BORDER}'""",
)
def w13b(i: Inputs):
    """Two runs of the collector into one store, as their log has them."""
    folder, later = _folder(i, "runs"), F.col("not_before") >= F.lit(_BORDER).cast("timestamp")
    store = jobs.seen_store(i.spark, f"{folder}/seen")
    certs = i.cert.select("raw_name", "not_before")
    runs.collect(certs.where(~later), store, 0, f"{folder}/log", "earlier")
    runs.collect(certs.where(later), store, 1, f"{folder}/log", "later", complete=False)
    return runs.read_log(i.spark, f"{folder}/log").select("source", "fetched", "inserted_new", "status")


_CUTOFF = "2024-01-11 06:00:00"


@query(
    "w8_retention_by_day",
    f"""SELECT channel, count(*) AS kept, (SELECT count(*) FROM message_analyses WHERE received_at < TIMESTAMP '{_CUTOFF}') AS purged
        FROM message_analyses WHERE received_at >= TIMESTAMP '{_CUTOFF}' GROUP BY channel""",
)
def w8c(i: Inputs):
    """Retention on a table of days: whole days go as folders, the border day is filtered."""
    rows, path = i.message_analyses, _folder(i, "days")
    dated_tables.write_days(rows, path, "received_at")
    purged = dated_tables.drop_before(i.spark, path, rows.schema, "received_at", _CUTOFF)
    left = dated_tables.read_days(i.spark, path, rows.schema)
    return left.groupBy("channel").agg(F.count("*").alias("kept")).withColumn("purged", F.lit(purged).cast("long"))


@query(
    "s8_day_of_days",
    "SELECT id, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at FROM message_analyses WHERE received_at >= TIMESTAMP '2024-01-05 00:00:00' AND received_at < TIMESTAMP '2024-01-07 00:00:00'",
)
def s8b(i: Inputs):
    """Two days of a table of days; the others are not opened."""
    rows, path = i.message_analyses, _folder(i, "days")
    dated_tables.write_days(rows, path, "received_at")
    found = dated_tables.read_days(i.spark, path, rows.schema, "2024-01-05", "2024-01-06")
    return found.select("id", F.date_format("received_at", ISO).alias("received_at"))
