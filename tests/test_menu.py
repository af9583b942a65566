"""The model menu: fits against numpy, group-safe folds, choices, frozen packages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import menu


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(240, 3))
    y = 100 + x @ [5.0, -2.0, 0.0] + 0.1 * r.normal(size=240)
    x[::17, 1] = np.nan
    data = [(int(i % 12), *(None if np.isnan(v) else float(v) for v in x[i]), 1.0, float(y[i]), int(y[i] > 100)) for i in range(240)]
    return spark.createDataFrame(data, "who long, a double, b double, c double, same double, y double, usable int").cache()


FEATURES = ["a", "b", "c", "same"]


def test_least_squares_held_out_by_group_against_numpy(rows):
    d = menu.with_folds(rows, "who", 3)
    assert d.groupBy("who").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    got = menu.held_out(d, {"ols": menu.regressors(FEATURES, "y")["ols"]}, 3).toPandas()
    assert len(got) == 240
    every = d.toPandas()
    for k, test in got.groupby("fold"):
        train = every[every.fold != k]
        mid = train[["a", "b", "c"]].median()
        design = lambda p: np.c_[np.ones(len(p)), p[["a", "b", "c"]].fillna(mid)]  # noqa: B023, E731
        w = np.linalg.lstsq(design(train), train.y, rcond=None)[0]
        assert np.allclose(test.prediction, design(test) @ w, atol=0.2)


def test_choice_by_error(rows):
    models = {k: v for k, v in menu.regressors(FEATURES, "y").items() if k in ("ols", "boosted_trees")}
    s = {r.model: r for r in menu.chosen(menu.errors(menu.held_out(menu.with_folds(rows, "who", 2), models, 2), ["model"], "y"), []).collect()}
    assert s["ols"].chosen and not s["boosted_trees"].chosen and s["ols"].mae < s["boosted_trees"].mae


def test_locked_rows_take_no_part_in_the_choice(rows):
    d = rows.withColumns({"fold": (F.col("who") % 3).cast("int"), "split": F.when(F.col("who") < 9, "development").otherwise("locked")})
    models = {k: v for k, v in menu.regressors(FEATURES, "y").items() if k in ("ols", "elastic_net")}
    best, locked, scores = menu.forward_chain(d, models, "y", 2)
    spoilt = d.withColumn("y", F.when(F.col("split") == "locked", 0.0).otherwise(F.col("y")))
    again, _, same = menu.forward_chain(spoilt, models, "y", 2)
    assert best == again and sorted(map(tuple, scores.collect())) == sorted(map(tuple, same.collect()))
    assert locked.count() == 60 and {r.who for r in locked.select("who").distinct().collect()} == {9, 10, 11}


def test_classifiers_and_importance(rows):
    d = menu.with_folds(menu.balanced(rows, "usable"), "who", 2)
    w = d.groupBy("usable").agg(F.sum("weight").alias("w")).collect()
    assert abs(w[0].w - w[1].w) < 1e-6
    p = menu.held_out(d, menu.classifiers(FEATURES, "usable", 10), 2)
    assert all(r.ok > 0.85 for r in p.groupBy("model").agg(F.avg((F.col("prediction") == F.col("usable")).cast("double")).alias("ok")).collect())
    assert p.where("score < 0 or score > 1 or score is null").count() == 0
    for m in menu.classifiers(FEATURES, "usable", 10).values():
        order = menu.importance(m.fit(d), FEATURES)
        assert order[0][0] == "a" and ("same", 0.0) in order


def test_frozen_models_fail_closed(spark, rows, tmp_path):
    path = str(tmp_path / "package")
    model = menu.regressors(FEATURES, "y")["ridge"].fit(rows)
    menu.freeze(model, path, FEATURES, "y", version=1)
    back = menu.thaw(spark, path, FEATURES, "y")
    a, b = (sorted(r.prediction for r in m.transform(rows).collect()) for m in (model, back))
    assert a == b
    with pytest.raises(ValueError):
        menu.thaw(spark, path, FEATURES[::-1], "y")
    with pytest.raises(ValueError):
        menu.thaw(spark, path, FEATURES, "other")
    with pytest.raises(Exception):
        menu.freeze(model, path, FEATURES, "y")
    other = str(tmp_path / "changed")
    model.write().save(f"{other}/model")
    text = spark.read.text(f"{path}/manifest").first().value.replace('"version": 1', '"version": 2')
    spark.createDataFrame([(text,)], "value string").write.text(f"{other}/manifest")
    with pytest.raises(ValueError):
        menu.thaw(spark, other, FEATURES, "y")


def test_a_changed_model_file_is_noticed(spark, rows, tmp_path):
    path = str(tmp_path / "package")
    models = menu.regressors(FEATURES, "y")
    menu.freeze(models["ridge"].fit(rows), path, FEATURES, "y")
    menu.thaw(spark, path, FEATURES, "y")
    models["ridge"].fit(rows.withColumn("y", F.col("y") * 2)).write().overwrite().save(f"{path}/model")
    with pytest.raises(ValueError, match="files were changed"):
        menu.thaw(spark, path, FEATURES, "y")


def test_impossible_pressures_are_withheld(spark):
    d = spark.createDataFrame([(120.0, 80.0), (80.0, 80.0), (500.0, 80.0), (float("nan"), 80.0), (None, 80.0)], "s double, d double")
    got = [tuple(r) for r in menu.guarded(d, "s", "d").select("s", "d", "status").collect()]
    assert got == [(120.0, 80.0, "estimate")] + [(None, None, "withheld")] * 4
