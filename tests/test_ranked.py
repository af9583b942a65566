"""Places in a whole order, and what is drawn by them, once ranges are drawn from samples."""

from pyspark.sql import functions as F

from pulseloom.operators import models
from pulseloom.operators import studies as st


def test_places_are_gapless_whatever_columns_are_asked_for(spark):
    df = spark.range(0, 120_000, 1, 4).select(F.xxhash64("id").alias("k"), F.col("id").alias("v"))
    r = st.ranked(df, F.col("k"))
    assert r.select("rank").agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first() == (120_000, 0, 119_999)
    assert "InMemoryTableScan" in r._jdf.queryExecution().executedPlan().toString()


def test_picks_are_not_gathered(spark):
    df = spark.range(50).select((F.col("id") % 10).alias("g"), F.col("id").cast("double").alias("x"))
    b = models.bootstrap_mean(df, "g", "x", draws=20)
    assert "ShuffledHashJoin" in b._jdf.queryExecution().executedPlan().toString() or "shuffle_hash" in b._jdf.queryExecution().optimizedPlan().toString()
    row = b.first()
    assert row.groups == 10 and row.low <= row["mean"] <= row.high
