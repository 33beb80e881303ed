"""Landed snapshots: registration JSON, registry bootstrap, blacklist answers, labelled samples, table dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brandsieve.functions.domains import strip

RDAP_SCHEMA = (
    "handle STRING, ldhName STRING, status ARRAY<STRING>, "
    "events ARRAY<STRUCT<eventAction: STRING, eventDate: STRING>>, "
    "nameservers ARRAY<STRUCT<ldhName: STRING, handle: STRING>>, "
    "entities ARRAY<STRUCT<roles: ARRAY<STRING>, handle: STRING, "
    "publicIds: ARRAY<STRUCT<type: STRING, identifier: STRING>>, vcardArray: ARRAY<STRING>>>"
)
BLACKLIST_SCHEMA = "query_status STRING, urls ARRAY<STRING>"
LABELLED_SCHEMA = "id STRING, type STRING, content STRING, label STRING, category STRING, source STRING"
DEFAULT_RDAP_URL = "https://rdap.org/"  # fixed value: fallback endpoint


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Watchlist CSV files with a header; the order of files, by name, and of lines becomes ``brand_idx``.

    The place of a row is taken from its file's name and the place of its block in the file, so the order
    does not depend on how Spark cuts files into tasks. Lines that are no CSV row of these columns come back in
    ``_corrupt`` with nulls.
    """
    schema = "brand_name STRING, aliases STRING, official_domain STRING, category STRING, match_mode STRING, source STRING, _corrupt STRING"
    rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    # a watchlist is a small dimension: one ordered numbering of its rows
    place = Window.orderBy("_file", "_block", "_row")
    return rows.withColumn("brand_idx", (F.row_number().over(place) - 1).cast("long")).drop("_file", "_block", "_row")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELLED_SCHEMA).json(path)


def parse_labelled(lines: DataFrame, line: str = "value") -> DataFrame:
    return lines.select(F.from_json(line, LABELLED_SCHEMA).alias("s")).select("s.*").where(F.col("id").isNotNull())


def _present(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def _registrar(entity: Column) -> Column:
    """vCard ``fn``, else handle, else first public id. The vCard mixes types, so it is read in two steps."""
    items = F.from_json(F.get(entity["vcardArray"], F.lit(1)), "ARRAY<ARRAY<STRING>>")
    fn = F.filter(
        F.transform(F.filter(items, lambda x: F.get(x, F.lit(0)) == "fn"), lambda x: _present(F.get(x, F.lit(3)))),
        lambda x: x.isNotNull(),
    )
    ids = F.filter(F.transform(entity["publicIds"], lambda p: _present(p["identifier"])), lambda x: x.isNotNull())
    return F.coalesce(F.get(fn, F.lit(0)), _present(entity["handle"]), F.get(ids, F.lit(0)))


def parse_rdap(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """Registration JSON text to registration_date, registrar, nameservers, status (arrays)."""
    rest = [c for c in answers.columns if c != payload]
    p = F.col("_p")
    first_event = F.get(F.filter(p["events"], lambda e: e["eventAction"] == "registration"), F.lit(0))
    registrars = F.filter(
        F.transform(
            F.filter(p["entities"], lambda e: F.exists(e["roles"], lambda r: F.lower(r) == "registrar")), _registrar
        ),
        lambda r: r.isNotNull(),
    )
    hosts = F.transform(
        p["nameservers"], lambda n: F.rtrim(F.lower(strip(F.coalesce(F.when(n["ldhName"] != "", n["ldhName"]), n["handle"]))), F.lit("."))
    )
    empty = F.array().cast("array<string>")
    return answers.withColumn("_p", F.from_json(payload, RDAP_SCHEMA)).select(
        *rest,
        first_event["eventDate"].alias("registration_date"),
        F.get(registrars, F.lit(0)).alias("registrar"),
        F.coalesce(F.array_distinct(F.filter(hosts, lambda h: h != "")), empty).alias("nameservers"),
        F.coalesce(F.transform(F.filter(p["status"], lambda s: s != ""), strip), empty).alias("status"),
    )


def parse_bootstrap(docs: DataFrame, payload: str = "payload", order: str = "doc_seq") -> DataFrame:
    """Registry bootstrap JSON to (tld, rdap_url): first url of a service, the latest service wins."""
    url = F.get(F.get("s", F.lit(1)), F.lit(0))
    return (
        docs.select(order, F.from_json(payload, "services ARRAY<ARRAY<ARRAY<STRING>>>").alias("p"))
        .select(order, F.posexplode("p.services").alias("pos", "s"))
        .where(url.isNotNull())
        .select(
            F.struct(order, "pos").alias("at"),
            F.when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/"))).alias("rdap_url"),
            F.explode(F.get("s", F.lit(0))).alias("tld"),
        )
        .groupBy(F.btrim(F.lower("tld"), F.lit(".")).alias("tld"))
        .agg(F.max_by("rdap_url", "at").alias("rdap_url"))
    )


def parse_blacklist(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """Blacklist JSON to status and reported url count; anything unexpected is ``unknown``."""
    rest = [c for c in answers.columns if c != payload]
    status = F.col("_p.query_status")
    return answers.withColumn("_p", F.from_json(payload, BLACKLIST_SCHEMA)).select(
        *rest,
        F.when(status == "ok", "listed").when(status == "no_results", "not_listed").otherwise("unknown").alias("status"),
        F.when(status == "ok", F.coalesce(F.size("_p.urls"), F.lit(0))).alias("reported_urls"),
    )


def snapshot_table(docs: DataFrame, table: str, row_schema: str, payload: str = "payload") -> DataFrame:
    """One table of a ``{table: [rows]}`` JSON dump."""
    return docs.select(F.from_json(payload, f"{table} ARRAY<STRUCT<{row_schema}>>").alias("p")).select(
        F.inline(f"p.{table}")
    )


def read_snapshot(spark: SparkSession, path: str, table: str, row_schema: str) -> DataFrame:
    return spark.read.schema(f"{table} ARRAY<STRUCT<{row_schema}>>").json(path, multiLine=True).select(F.inline(table))


def write_findings_csv(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").csv(path, header=True)


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per table; rows stay distributed."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
