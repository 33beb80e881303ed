"""Signatures of name servers are evaluated once in each scan of the findings."""

from pyspark.sql import functions as F

from brandsieve.functions.domains import nameserver_signature
from brandsieve.operators import campaigns
from brandsieve.session import build_session


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_signatures_are_evaluated_once_a_scan():
    spark = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")
    rows = spark.createDataFrame([], "id long, nameservers string, matched_brand string, match_method string, first_seen timestamp")
    # nine scans, four times in the text of each; filters on the signature carry no copies
    assert plan(campaigns.label_findings(rows)).count("split(nameservers") <= 36
    sigs = spark.createDataFrame([(" NS1.a.co.id. ;;ns2.b.net;ns9.b.net; . ",), (" ; ",)], "n string").select(nameserver_signature(F.col("n")))
    assert [r[0] for r in sigs.collect()] == ["a.co.id,b.net", None]
