"""The plans that describe blocks and find what names levels stay small: the driver holds them in memory."""

import pytest

from strataloom.operators import response as R
from strataloom.plans import levels as P

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "most"), [("described", 40_000), ("mentions", 60_000)])
def test_characters(spark, name, most):
    df = R.described(P._plan(spark, SF), P.TAILS, P.KNOWN, P.MARKERS)
    if name == "mentions":
        df = R.mentions(spark.createDataFrame([], df.schema), P.KNOWN)
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < most
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
