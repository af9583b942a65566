"""Order statistics against numpy, in frames and groups beyond what is sorted at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import orderstats as o

SCHEMA = "user_id long, event_id long, us long, value double"


def frame(spark, n=700, keys=(1, 2, None), seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for k in keys:
        t = np.cumsum(r.integers(0, 40, n))
        v = np.round(r.normal(size=n) * 5, 1)
        rows += [(k, i, int(t[i]), None if r.random() < 0.1 else float(v[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(("before", "after", "chunk", "block"), [(5, 5, 64, 500), (50, 50, 40, 10**9), (300, 10, 100, 77), (0, 0, 1000, 1000), (2000, 2000, 50, 10**9)])
def test_rolling_medians_of_any_frame(spark, before, after, chunk, block):
    rows, df = frame(spark, 260)
    want = {}
    for k in (1, 2, None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(own):
            some = [x[3] for x in own[max(0, i - before) : i + after + 1] if x[3] is not None]
            want[k, r[1]] = float(np.median(some)) if some else None
    got = {(r.user_id, r.event_id): r.mid for r in o.rolling_median(df, ["user_id"], "us", "event_id", "value", before, after, chunk=chunk, block=block).collect()}
    assert got == want


def test_counted_tree_and_long_frames():
    r = np.random.default_rng(4)
    x = r.normal(size=21_000)
    got = o.sliding_medians(x, 0, len(x), 5000, 5000)  # frames of 10,001 rows
    for i in (0, 1, 4999, 5000, 10_000, 15_999, 20_999):
        assert got[i] == np.median(x[max(0, i - 5000) : i + 5001])
    tree = o.CountedTree(13)
    for k in (3, 3, 12, 0, 7):
        tree.add(k)
    tree.add(3, -1)
    assert [tree.at(i) for i in range(tree.count)] == [0, 3, 7, 12]


@pytest.mark.parametrize(("q", "bins", "finish"), [(0.5, 1024, 4096), (0.5, 4, 3), (0.25, 7, 0), (0.975, 2, 10), (0.0, 3, 1), (1.0, 3, 1)])
def test_quantiles_by_narrowing(spark, q, bins, finish):
    r = np.random.default_rng(7)
    groups = {"a": r.normal(size=900), "ties": np.r_[np.full(500, 3.0), r.integers(0, 5, 400)], "one": [4.5], "two": [1.0, 2.0], "wide": [1e308, -1e308, 0.0, 5.0, 1e-300] * 9, "same": np.full(300, -2.5), None: r.exponential(size=50)}
    df = spark.createDataFrame(pd.DataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("none", np.nan), ("a", np.inf), ("a", np.nan)], columns=["g", "v"]), "g string, v double").repartition(4)
    got = {x.g: x.mid for x in o.quantiles(df, ["g"], "v", q, bins=bins, finish=finish).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        x = np.sort(np.asarray(x, float))
        at = (len(x) - 1) * q
        a, b = x[int(np.floor(at))], x[int(np.ceil(at))]
        assert got[g] == pytest.approx(a + (b - a) * (at - np.floor(at)), rel=1e-12) or abs(a - b) > 1e307


def test_robust_thresholds_and_places(spark):
    rows, df = frame(spark)
    got = {r.user_id: (r.mid, r.mad, r.threshold) for r in o.robust_thresholds(df, ["user_id"], "value", bins=8, finish=5).collect()}
    for k in (1, 2, None):
        x = np.array([r[3] for r in rows if r[0] == k and r[3] is not None])
        mid = np.median(x)
        mad = 1.4826 * np.median(np.abs(x - mid))
        assert got[k] == pytest.approx((mid, mad, mid + 6 * mad))
    places = o.numbered(df, ["user_id"], "us", "event_id", "nth", 333)
    assert {r.n: r.m for r in places.groupBy("user_id").agg(F.countDistinct("nth").alias("n"), F.max("nth").alias("m")).collect()} == {700: 699}
    for r in places.collect():
        assert r.nth == sum(1 for x in rows if x[0] == r.user_id and (x[2], x[1]) < (r.us, r.event_id))
