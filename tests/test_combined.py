"""The setup-aware ridge against loops over its folds, and its guards."""

import numpy as np
import pandas as pd
import pytest

from pulseloom.operators import combined as c

D = c.Design(setup="setup", target_setup="new", time="us", tie="id", features=("a", "b"), targets=("y", "z"), setups=("old", "new", "other"), alphas=(0.5, 20.0), splits=3)


def rows(n=150, seed=2):
    r = np.random.default_rng(seed)
    d = pd.DataFrame({"id": range(n), "us": np.sort(r.integers(0, 10_000, n)), "setup": r.choice(["old", "new", "other"], n), "a": r.normal(size=n) * 3, "b": r.normal(size=n) + 5})
    own = d.setup.map({"old": 1.0, "new": 2.0, "other": -1.0})
    d["y"], d["z"] = own * d.a + 0.5 * d.b + own + r.normal(size=n) * 0.3, -d.b + r.normal(size=n)
    return d


def ridge(train, test, columns, target, alpha):
    x, y, v = train[columns].to_numpy(float), train[target].to_numpy(), test[columns].to_numpy(float)
    sd = x.std(axis=0)
    use = sd > 1e-12
    z = (x[:, use] - x[:, use].mean(axis=0)) / sd[use]
    w = np.linalg.solve(z.T @ z + alpha * np.eye(use.sum()), z.T @ (y - y.mean()))
    return y.mean() + ((v[:, use] - x[:, use].mean(axis=0)) / sd[use]) @ w


def wide(d):
    d = d.copy()
    for s in ("old", "other"):
        for f in ("a", "b"):
            d[f"{f}__of_{s}"] = np.where(d.setup == s, d[f], 0.0)
        d[f"level__of_{s}"] = (d.setup == s).astype(float)
    return d


@pytest.fixture(scope="module")
def fitted(spark):
    d = rows()
    scores, models = c.selected(spark.createDataFrame(d).repartition(3), D, block=700)
    return d, scores.collect(), models


def test_scores_of_later_rows_from_earlier_ones(fitted):
    d, scores, _ = fitted
    x = wide(d)
    own = x[x.setup == "new"].sort_values(["us", "id"])
    size = len(own) // 4
    want = {}
    for alpha in D.alphas:
        for variant in ("combined", "alone"):
            for name, columns in D.sets.items():
                for target in D.targets:
                    off = []
                    for k in range(3):
                        val = own.iloc[len(own) - (3 - k) * size : len(own) - (2 - k) * size]
                        train = x[x.us < val.us.min()]
                        train = train[train.setup == "new"] if variant == "alone" else train
                        off += list(np.abs(ridge(train, val, columns, target, alpha) - val[target]))
                    want[variant, name, target, alpha] = (len(off), np.mean(off))
    got = {(r.variant, r.model, r.target, r.alpha): (r.n, r.mae) for r in scores}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    for target in D.targets:
        chosen = [r for r in scores if r.chosen and r.target == target]
        assert len(chosen) == 1 and chosen[0].mae == min(r.mae for r in scores if r.target == target)
    assert next(r for r in scores if r.chosen and r.target == "y").model == "partial"  # the setups differ there


def test_locked_rows_are_judged_once(spark, fitted, tmp_path):
    d, scores, models = fitted
    late = rows(60, 9).assign(us=lambda t: t.us + 20_000)
    df = spark.createDataFrame(late)
    out = c.judged_once(df, models, D, int(d.us.max()), str(tmp_path / "once"))
    got = {r.target: r for r in c.summary(out).collect()}
    x, v = wide(d), wide(late[late.setup == "new"])
    for r in scores:
        if r.chosen:
            train = x if r.variant == "combined" else x[x.setup == "new"]
            e = ridge(train, v, D.sets[r.model], r.target, r.alpha) - v[r.target]
            assert got[r.target].n == len(v) and abs(got[r.target].mae - np.abs(e).mean()) < 1e-8 and abs(got[r.target].worst - np.abs(e).max()) < 1e-8
    with pytest.raises(Exception, match="(?i)exist"):
        c.judged_once(df, models, D, int(d.us.max()), str(tmp_path / "once"))
    with pytest.raises(ValueError, match="later"):
        c.judged_once(spark.createDataFrame(d), models, D, int(d.us.max()))


def test_too_few_rows_are_refused(spark):
    with pytest.raises(ValueError, match="too few"):
        c.selected(spark.createDataFrame(rows(12)), D)
