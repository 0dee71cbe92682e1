"""Field extraction strips separators from a line once for each look at it, not once for each label that it is held against."""

from pyspark.sql import functions as F

from strataloom.operators import fields as X


def test_separators_are_stripped_outside_the_labels(spark):
    row = spark.createDataFrame([("企 业：名称", ["名称", "企业"])], "text string, stops array<string>")
    row = row.withColumn("line", F.struct("text"))
    shown = row.select(X._known(F.col("line"), F.col("stops")).alias("k"), X._first_stop(F.col("text"), F.col("stops")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" in shown
    assert "lambdafunction(Contains(regexp_replace" not in shown and "lambdafunction((instr(regexp_replace" not in shown
    got = row.select(X._known(F.col("line"), F.col("stops")).alias("k"), X._first_stop(F.col("text"), F.col("stops")).alias("s")).first()
    assert (got["k"], got["s"]) == (True, 0)
