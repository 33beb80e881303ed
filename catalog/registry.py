"""Query registration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from catalog.landing import TABLES, check_sql, spark_view


@dataclass
class Inputs:
    """Lazy access to the given tables and the landing views."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spark_view(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register ``fn(inputs)`` under ``name`` with its SQL check."""

    def register(fn: Callable[[Inputs], DataFrame]):
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the views hold UTC timestamps
            # a generated method above HotSpot's limit is never compiled; such a subtree runs faster expression by expression
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return fn(Inputs(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = check_sql(sql, ctes)
        return fn

    return register
