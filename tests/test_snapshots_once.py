"""The tables that a funnel stream reads in each batch are derived once."""

from pyspark.sql import functions as F

from brandsieve.session import build_session
from brandsieve.streaming import jobs


def test_batches_read_what_was_derived_once(tmp_path):
    spark = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")
    derived = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(n):
        derived.add(1)
        return n

    table = spark.range(10, numPartitions=2).select(counted("id").alias("n"))
    (again,) = jobs.once_for_all({"rdap": table}, str(tmp_path))
    for _ in range(3):  # batches
        assert sorted(r["n"] for r in again.collect()) == list(range(10))
    assert derived.value == 10
