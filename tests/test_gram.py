"""Models from moments against plain least squares on the rows themselves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import gram as g

FEATURES, TARGETS = ["a", "b", "c", "d"], ["y", "z"]
SETS = {"small": ["a"], "middle": ["a", "b"], "whole": ["a", "b", "c", "d"], "odd": ["d", "b"]}


def rows(n=240, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4)) * [1, 10, 0.1, 1] + [1e6, -50, 0, 3]
    x[:, 3] = 7.0  # no spread
    d = pd.DataFrame(x, columns=FEATURES)
    d["who"] = r.integers(0, 7, n)
    d["y"] = 2 * (x[:, 0] - 1e6) - 0.3 * x[:, 1] + r.normal(size=n) + 120
    d["z"] = 5 * x[:, 2] + r.normal(size=n)
    return d


def plain(d, chosen, target, alpha):
    """Ridge over standardised columns, by the normal equations of the rows."""
    x, y = d[chosen].to_numpy(), d[target].to_numpy()
    sd = x.std(axis=0)
    z = np.where(sd > 1e-12, (x - x.mean(axis=0)) / np.where(sd > 1e-12, sd, 1), 0)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(len(chosen)), z.T @ (y - y.mean()))
    w = np.where(sd > 1e-12, w / np.where(sd > 1e-12, sd, 1), 0)
    return y.mean() - w @ x.mean(axis=0), w


@pytest.mark.parametrize("alpha", [1.0, 25.0])
def test_every_group_is_left_out_by_subtraction(spark, alpha):
    d = rows()
    df = spark.createDataFrame(d).repartition(3).unionByName(spark.createDataFrame(d[:3].assign(a=np.nan)))
    got = g.left_out(df, "who", FEATURES, TARGETS, SETS, alpha, held=F.col("who") < 5).collect()
    assert len(got) == 5 * len(SETS) * 2  # groups 5 and 6 are auxiliary: always fitted to, never left out
    for r in got:
        rest = d[d.who != r.who]
        intercept, w = plain(rest, SETS[r.model], r.target, alpha)
        assert r.n_train == len(rest)
        of = dict(zip(FEATURES, r.coefficients, strict=True))
        assert np.allclose([of[f] for f in SETS[r.model]], w, rtol=1e-6, atol=1e-9) and all(of[f] == 0 for f in FEATURES if f not in SETS[r.model])
        assert abs(r.intercept - intercept) < 1e-6 * max(1, abs(intercept))


def test_predictions_of_held_out_rows(spark):
    d = rows()
    df = spark.createDataFrame(d).repartition(3)
    p = g.predicted(df, g.left_out(df, "who", FEATURES, TARGETS, SETS), ["who"], FEATURES).where("model = 'whole' and target = 'y'").toPandas()
    assert len(p) == len(d)
    for who in range(7):
        intercept, w = plain(d[d.who != who], FEATURES, "y", 1.0)
        own = p[p.who == who]
        assert np.allclose(own.predicted, intercept + own[FEATURES].to_numpy() @ w, atol=1e-5)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame(rows()[:1])
    got = g.left_out(df, "who", FEATURES, TARGETS, SETS).collect()
    assert all(r.n_train == 0 and r.intercept is None for r in got) and len(got) == 8
    assert g.left_out(df.limit(0), "who", FEATURES, TARGETS, SETS).collect() == []


def test_half_widths_by_rank_of_the_worst(spark):
    errors = spark.createDataFrame([("s", k, e) for k in range(9) for e in (k * 1.0, -0.5)] + [("few", 1, 3.0)], "band string, who long, e double")
    got = {r.band: r.half_width for r in g.half_widths(errors, ["band"], "who", "e", 0.8, 3).collect()}
    assert got == {"s": 7.0, "few": float("inf")}
    assert {r.half_width for r in g.half_widths(errors, ["band"], "who", "e", 1.0, 3).collect()} == {float("inf")}


def test_a_constant_column_stays_one_over_a_million_rows():
    """Rounding left spread in columns that are constant in a group far from the overall mean, and no Cholesky factor."""
    r = np.random.default_rng(0)
    n, sets = 1_000_000, {"pooled": ["x"], "partial": ["x", "of", "level"]}
    for parts in (2, 3, 5, 13):
        for _ in range(4):
            c = np.array([150.1 + r.random(), 75.03 + r.random(), 0.5001 - r.random() * 1e-3, 150.2])
            x = r.random(n) * 400
            v = [np.ones(n), x - c[0], np.full(n, -c[1]), np.full(n, -c[2]), 0.3 * x + r.random(n) * 100 - c[3]]
            sums = [sum(np.cumsum(part)[-1] for part in np.array_split(v[i] * v[j], parts)) for i in range(5) for j in range(i, 5)]
            got = g.solved(g.unpacked(np.array([sums]), 5), sets["partial"], ["t"], sets, 1.0, c)
            assert abs(got["pooled", "t"][1][0, 0] - 0.3) < 0.01
            assert np.allclose(got["pooled", "t"][1], got["partial", "t"][1], atol=1e-9) and np.allclose(got["pooled", "t"][0], got["partial", "t"][0])
