"""Running sums that do not need a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows of the key up to this one (itself included or not).

    ``bucket`` must rise with ``order``. Sums per (key, bucket) come from a map-side combining
    aggregation, their prefix is a window over buckets (few rows per key), and only the rest is a
    window over rows, inside one bucket. A key with a third of all rows is spread over its buckets.
    """
    rows = rows.withColumn("_bucket", bucket).withColumn("_value", value)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        rows.join(before, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_bucket", "_value", "_before")
    )
