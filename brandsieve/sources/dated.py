"""Tables partitioned by UTC day: days are written, read and dropped as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brandsieve.sources import files

DAY = "day"
#: Files that a day is written to, so that one large day is no single task.
FILES_PER_DAY = 4


def write_days(rows: DataFrame, path: str, at: str, files_per_day: int = FILES_PER_DAY) -> None:
    """Write ``rows`` under the day of ``at``. Days that occur in ``rows`` are replaced, all others stay: a rerun of a day changes nothing.

    Rows without a time go under the default day, which no slice reads.
    """
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(files_per_day))
    (
        rows.withColumn(DAY, F.to_date(at))
        .repartition(F.col(DAY), spread)
        .sortWithinPartitions(DAY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(path)
    )


def read_days(spark: SparkSession, path: str, schema: T.StructType, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of the days from ``first`` to ``last`` (both included); folders of other days are not opened."""
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])).parquet(path)
    if first is not None:
        found = found.where(F.col(DAY) >= F.lit(first).cast("date"))
    if last is not None:
        found = found.where(F.col(DAY) <= F.lit(last).cast("date"))
    return found.drop(DAY)


def days(spark: SparkSession, path: str) -> list[str]:
    """The days of the table, from the names of its folders."""
    found = (n.partition("=")[2] for n in files.names(spark, path) if n.startswith(f"{DAY}="))
    return sorted(d for d in found if d[:1].isdigit())


def drop_before(spark: SparkSession, path: str, schema: T.StructType, at: str, cutoff: str) -> int:
    """Retention: remove all rows with ``at`` before ``cutoff`` (a UTC timestamp); how many there were.

    Whole days go as folders; only the day of the cutoff is read and written again. The border day goes first
    to a folder of its own, so a lost executor leaves the old one in place.
    """
    border = cutoff[:10]
    old = [d for d in days(spark, path) if d < border]
    gone = read_days(spark, path, schema, last=old[-1]).count() if old else 0  # row counts of the files' footers
    for d in old:
        files.remove(spark, f"{path}/{DAY}={d}")
    if border in days(spark, path):
        before = F.col(at) < F.lit(cutoff).cast("timestamp")
        rows = read_days(spark, path, schema, border, border)
        late = rows.where(before).count()
        if late:
            gone += late
            aside = f"{path}/_{DAY}={border}"  # a name that readers pass over
            rows.where(~before).write.mode("overwrite").parquet(aside)
            write_days(spark.read.schema(schema).parquet(aside), path, at)
            if spark.read.schema(schema).parquet(aside).isEmpty():
                files.remove(spark, f"{path}/{DAY}={border}")
            files.remove(spark, aside)
    return gone
