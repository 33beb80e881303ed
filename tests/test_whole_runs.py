"""Queries over whole tables, where the SQL check or its input would hide a cut."""

import pytest

from __spark_entry__ import queries
from brandsieve.plans import funnel
from brandsieve.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")


def test_upsert_takes_every_finding_of_the_run_of_now(spark):
    of = lambda name: {r["domain"]: [r[c] for c in funnel.UPSERT_COLUMNS] for r in queries()[name](spark, SF).collect()}
    now, table = of("p3_p4_funnel_findings"), of("p3_w2_funnel_upsert")
    assert now and {d: table.get(d) for d in now} == now
