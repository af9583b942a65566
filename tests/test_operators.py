import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulseloom.functions.expr import band, reasons
from pulseloom.operators import intervals as iv
from pulseloom.operators import models
from pulseloom.operators import series as se
from pulseloom.operators import studies as st


def frame(spark, seed=0, n=300):
    r = np.random.default_rng(seed)
    return spark.createDataFrame(pd.DataFrame({"user_id": r.integers(0, 4, n), "event_id": range(n), "us": np.sort(r.integers(0, 5000, n)), "value": r.normal(size=n)}))


def test_exponential_and_hysteresis_match_loops(spark):
    df = frame(spark)
    rows = sorted(df.collect(), key=lambda r: (r.us, r.event_id))
    ema, states, g = {}, {}, {}
    machine = {}
    for r in rows:
        g[r.user_id] = r.value if r.user_id not in g else g[r.user_id] + 0.2 * (r.value - g[r.user_id])
        ema[r.event_id] = g[r.user_id]
        s, up, down = machine.get(r.user_id, (0, 0, 0))
        up, down = (up + 1 if r.value > 0.5 else 0), (down + 1 if r.value < 0 else 0)
        s = 1 if s == 0 and up >= 2 else 0 if s == 1 and down >= 3 else s
        machine[r.user_id] = s, up, down
        states[r.event_id] = s
    assert {r.event_id: round(r.ema, 9) for r in se.exponential(df, ["user_id"], "us", "event_id", "value", 0.2).collect()} == {k: round(v, 9) for k, v in ema.items()}
    assert {r.event_id: r.state for r in se.hysteresis(df, ["user_id"], "us", "event_id", "value", 0.5, 0.0, 2, 3).collect()} == states


def test_intervals_touching_nested_and_empty(spark):
    rows = [(1, 0, 10), (1, 10, 20), (1, 12, 15), (1, 30, 40), (2, 5, 6)]
    df = spark.createDataFrame(rows, "user_id int, start_us long, end_us long")
    assert {r.user_id: (r.covered_us, r.n_islands) for r in iv.covered(df, ["user_id"]).collect()} == {1: (30, 2), 2: (1, 1)}
    assert iv.covered(df.where("false"), ["user_id"]).count() == 0
    other = spark.createDataFrame([(1, 8, 13), (1, 39, 99)], "user_id int, b_start_us long, b_end_us long")
    pairs = iv.overlaps(df, other, ["user_id"], 7).collect()
    assert sorted((r.start_us, r.common_start_us, r.common_end_us) for r in pairs) == [(0, 8, 10), (10, 10, 13), (12, 12, 13), (30, 39, 40)]


def test_asof_takes_the_latest_update_and_ties(spark):
    df = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 5, 3), (2, 9, 4)], "user_id int, us long, event_id int")
    up = spark.createDataFrame([(1, 10, 7, "a"), (1, 10, 8, "b"), (1, 15, 1, "c"), (3, 1, 1, "z")], "user_id int, us long, event_id int, level string")
    assert {r.event_id: r.asof_level for r in iv.asof(df, up, ["user_id"], "us", "event_id", ["level"]).collect()} == {1: "b", 2: "c", 3: None, 4: None}


def test_splits_do_not_leak(spark):
    df = spark.createDataFrame([(p, i, float(i)) for p in (1, 2) for i in range(17)], "p int, i int, v double")
    s = st.chronological(df, ["p"], "i").collect()
    assert max(r.i for r in s if r.split == "development") < min(r.i for r in s if r.split == "locked") and sum(r.split == "locked" for r in s) == 12
    folds = st.forward_folds(df, ["p"], "i").where("p = 1").orderBy("i").collect()
    assert [r.fold for r in folds] == [0] * 5 + [1] * 4 + [2] * 4 + [3] * 4


def test_ridge_left_out_equals_the_closed_form(spark):
    r = np.random.default_rng(3)
    d = pd.DataFrame({"g": r.integers(0, 5, 200), "a": r.normal(size=200), "b": r.normal(3, 2, size=200), "c": np.ones(200)})
    d["y"] = 2 * d.a - d.b + r.normal(size=200)
    for row in models.ridge_left_out(spark.createDataFrame(d), "g", ["a", "b", "c"], "y", 2.0).collect():
        t = d[d.g != row.g]
        x, y = t[["a", "b"]].to_numpy(), t.y.to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + 2 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
        assert np.allclose([row.b_a, row.b_b], w, atol=1e-8) and row.b_c == 0 and abs(row.intercept - (y.mean() - w @ x.mean(0))) < 1e-8


def test_bootstrap_brackets_the_mean(spark):
    df = spark.range(2000).select((F.col("id") % 100).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    a, b = models.bootstrap_mean(df, "g", "v").first(), models.bootstrap_mean(df, "g", "v").first()
    assert a == b and a.low < a.mean < a.high and a.high - a.low < 0.4


def test_expressions(spark):
    row = spark.range(1).select(band(F.lit(float("nan")), [1.0], ["a", "b"]).alias("x"), band(F.lit(1.0), [1.0], ["a", "b"]).alias("y"), reasons(("z", F.lit(True)), ("a", F.lit(True)), ("m", F.lit(None).cast("boolean"))).alias("r")).first()
    assert tuple(row) == ("unknown", "b", "a;z")


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (4, None)], "k int, v string")
    assert {r.k: (r.v, r.action) for r in st.upsert(old, new, ["k"]).collect()} == {1: ("a", "kept"), 2: ("b", "duplicate_skipped"), 3: ("c", "updated"), 4: (None, "appended")}
