"""Certificate-transparency records: page JSON, SAN lists, earliest sight per host, run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandsieve.functions.domains import normalize_domain, strip

PAGE_SCHEMA = (
    "rows ARRAY<STRUCT<id: STRING, match: STRING, not_before: STRING, not_after: STRING, serial_hex: STRING, "
    "issuer: STRING, key_algo: STRING, san_count: INT>>, has_next BOOLEAN, next_cursor STRING, duration_ms INT"
)
ISO_ZONED = r"^\d{4}-\d{2}-\d{2}"


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to timestamp, null when it does not parse; text without a zone counts as UTC."""
    return F.when(text.rlike(ISO_ZONED), F.try_to_timestamp(text))


def read_ct_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page files, one JSON object per line."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def parse_ct_pages(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Page JSON text in a column to the columns of ``PAGE_SCHEMA``; bad JSON gives nulls."""
    return pages.withColumn("_p", F.from_json(payload, PAGE_SCHEMA)).select(*pages.columns, "_p.*").drop(payload)


def ct_rows(pages: DataFrame, since: Column) -> DataFrame:
    """(domain, not_before) per certificate row not older than ``since``; other columns are kept."""
    rest = [c for c in pages.columns if c not in ("rows", "has_next", "next_cursor", "duration_ms")]
    return (
        pages.select(*rest, F.explode("rows").alias("r"))
        .select(*rest, normalize_domain(F.col("r.match")).alias("domain"), parse_iso(F.col("r.not_before")).alias("not_before"))
        .where((F.col("not_before") >= since) & (F.col("domain") != ""))
    )


def san_names(records: DataFrame, name_value: str = "name_value") -> DataFrame:
    """Newline-separated SAN lists to one normalised host per row."""
    rest = [c for c in records.columns if c != name_value]
    return (
        records.select(*rest, F.explode(F.split(name_value, "\n")).alias("line"))
        .where(strip(F.col("line")) != "")
        .select(*rest, normalize_domain(F.col("line")).alias("domain"))
        .where(F.col("domain") != "")
    )


def earliest_by_domain(rows: DataFrame) -> DataFrame:
    """First certificate per host."""
    return rows.groupBy("domain").agg(F.min("not_before").alias("not_before"))


def fetch_status(per_zone: DataFrame) -> DataFrame:
    """Run status from one row per zone: (failed BOOLEAN, n_domains). All clean: ok; some yield: partial."""
    ok = F.count_if(~F.col("failed"))
    partial = F.count_if(F.col("failed") & (F.col("n_domains") > 0))
    lost = F.count_if(F.col("failed") & (F.col("n_domains") == 0))
    return per_zone.agg(ok.alias("ok_zones"), partial.alias("partial_zones"), lost.alias("failed_zones")).withColumn(
        "status",
        F.when((F.col("ok_zones") > 0) & (F.col("partial_zones") == 0) & (F.col("failed_zones") == 0), "ok")
        .when((F.col("ok_zones") > 0) | (F.col("partial_zones") > 0), "partial")
        .otherwise("failed"),
    )


def check_status(checked: Column, errors: Column) -> Column:
    """Run status of a candidate check."""
    return (
        F.when(checked == 0, "failed").when(errors == 0, "ok").when(errors < checked, "partial").otherwise("failed")
    )
