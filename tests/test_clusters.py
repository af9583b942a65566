"""Clusters whose values lie at the very limit of the reach, where sums and differences of doubles round apart."""

import random
from statistics import mean, pstdev

from pyspark.sql import functions as F

from pulseloom.operators import studies as st


def test_the_limit_is_a_difference(spark):
    r = random.Random(4)
    far = [(a / 100, (a + 500) / 100) for a in range(1, 3000)]
    odd = [p for p in far if p[1] - p[0] > 5 and p[0] + 5 >= p[1]]
    assert odd  # a range frame takes these in
    rows = [("pair", v) for v in odd[0]] + [("none", None), ("same", 1.0), ("same", 1.0), ("below", -3.0), ("below", 2.0)] + [("many", x) for p in r.sample(odd, 40) for x in p] + [("many", r.randrange(4000) / 100) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {(x.k, x.centre): x for x in st.neighbours(df, ["k"], "v", 5).collect()}
    want = {(k, a): [b for j, b in rows if j == k and abs(a - b) <= 5] for k, a in rows if a is not None}
    assert got.keys() == want.keys()
    for key, near in want.items():
        assert got[key].members == len(near) and abs(got[key]["mean"] - mean(near)) < 1e-9 and abs(got[key].spread - pstdev(near)) < 1e-7
    assert got["pair", odd[0][0]].members == 1 and got["below", 2.0].members == 2

    _, wins = st.winning_cluster(df, ["k"], "v", 5)
    best = {x.k: x for x in wins.collect()}
    assert best["pair"].members == 1 and best["pair"].runner_up == 1 and best["same"].members == 2 and best["same"].runner_up == 0
    top = max(len(b) for (k, _), b in want.items() if k == "many")
    assert best["many"].members == top and best["many"].n == 280
    frames = st.neighbours(df.where("k = 'pair'"), ["k"], "v", 5, lambda a, b: b.between(a - 5, a + 5)).agg(F.max("members")).first()[0]
    assert frames == 2
