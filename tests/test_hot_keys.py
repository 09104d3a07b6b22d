"""A hot key's rows lie in several tasks."""

from pyspark.sql import functions as F

from wardstone.operators import lifecycle


def test_a_hot_key_is_spread(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).when(F.col("id") % 4 != 1, F.lit("x")).alias("k"))
    side = spark.createDataFrame([("x", 1), ("x", 2), ("8", 3), (None, 4)], "k2 string, v int")
    got = lifecycle._looked_up(rows, "k", side, "k2", hot=64, share=4)
    want = rows.join(side, F.col("k") == F.col("k2"), "left").drop("k2")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.columns == want.columns
    assert "__salt" in got._jdf.queryExecution().executedPlan().toString()
