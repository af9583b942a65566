"""Streams against their batch twins."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseloom.operators import series as se
from pulseloom.operators import studies as st
from pulseloom.streaming.live import live_monitor, live_sessions, live_windows

SCHEMA = "user_id long, event_id long, us long, event_type string, value double"


def events(spark, n=400):
    r = np.random.default_rng(5)
    return spark.createDataFrame(pd.DataFrame({"user_id": r.integers(0, 3, n), "event_id": range(n), "us": np.cumsum(r.exponential(20, n)).astype(int), "event_type": r.choice(["view", "error"], n), "value": r.normal(size=n)}), SCHEMA)


def test_live_sessions_equal_the_batch(spark, tmp_path):
    df = events(spark)
    for k in range(4):  # four files, four batches in order
        df.where(f"event_id between {100 * k} and {100 * k + 99}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live_sessions(files, 150, 60, sequence=False).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    s = se.with_sessions(df, ["user_id"], "us", "event_id", 150)
    twin = se.held(s, ["user_id", "session"], "us", "event_id", F.when(F.col("event_type") != "error", F.col("value")), 60)
    want = {r.event_id: (r.session, r.mode, r.shown) for r in twin.collect()}
    assert {r.event_id: (r.session, r.mode, r.shown) for r in spark.table("live").collect()} == want


def test_live_windows_equal_the_batch(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 2).alias("user_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.col("id").cast("double").alias("value"))
    df.write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = live_windows(files).writeStream.format("memory").queryName("wins").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = df.groupBy(F.window("ts", "8 hours", "4 hours"), "user_id").agg(F.count("*").alias("n")).collect()
    assert {(r.user_id, r.start): r.n for r in spark.table("wins").collect()} == {(r.user_id, r.window.start): r.n for r in batch}


def streamed(spark, df, schema, make, name, tmp_path):
    """The result of make over df, read as four files in order of event_id."""
    for k in range(4):
        df.where(f"event_id div 100 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = make(files).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_a_step_of_sequence_or_an_equal_time_resets(spark, tmp_path):
    rows = [(1, i, 10 * i, "view", 1.0) for i in (0, 1, 2, 4, 5)] + [(1, 6, 50, "error", 1.0), (1, 7, 70, "error", 1.0)]
    got = streamed(spark, spark.createDataFrame(rows, SCHEMA), SCHEMA, lambda f: live_sessions(f, 1000, 1000, sequence=True), "steps", tmp_path)
    assert [(r.event_id, r.reset, r.mode) for r in sorted(got, key=lambda r: r.event_id)] == [(0, False, "current"), (1, False, "current"), (2, False, "current"), (4, True, "current"), (5, False, "current"), (6, True, "unavailable"), (7, False, "unavailable")]


def test_live_monitor_equals_the_batch_rules(spark, tmp_path):
    r = np.random.default_rng(6)
    n, keep = 400, 900
    schema = "user_id long, event_id long, us long, status string, counter long"
    df = spark.createDataFrame(pd.DataFrame({"user_id": r.integers(0, 3, n), "event_id": range(n), "us": np.cumsum(r.integers(1, 60, n)), "status": r.choice(["still", "still", "still", "still", "moving", "calibrating"], n), "counter": r.integers(0, 70, n)}), schema)
    got = {g.event_id: (g.reset, g.generation, g.buffered, g.analysed) for g in streamed(spark, df, schema, lambda f: live_monitor(f, 60, keep, 500), "monitor", tmp_path)}
    w = se.in_order(["user_id"], "us", "event_id")
    d = df.withColumns({"prev": F.lag("status").over(w), "pc": F.lag("counter").over(w)})
    d = d.withColumn("reset", st.reset_reason(F.col("status"), F.col("prev"), F.col("counter") > F.col("pc") + 60))
    d = d.withColumn("generation", F.sum(F.when(F.col("reset").isNotNull(), 1).otherwise(0)).over(w))
    key = Window.partitionBy("user_id", "generation")
    age = F.col("us") - F.min("us").over(key)
    d = d.withColumns({"age": age, "buffered": F.count(F.lit(1)).over(key.orderBy("us").rangeBetween(-keep, 0))})
    tick = F.floor(F.col("age") / 500)
    d = d.withColumn("analysed", (tick > 0) & (F.row_number().over(Window.partitionBy("user_id", "generation", tick).orderBy("us", "event_id")) == 1))
    assert got == {x.event_id: (x.reset, x.generation, x.buffered, x.analysed) for x in d.collect()} and any(v[3] for v in got.values())
