"""The model menu on Spark ML: fitting by folds of whole groups, selection by error, frozen packages that fail closed.

Folds are a column, so a fit is a filter and a pipeline; only folds and models are looped over, never rows.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUT = "prediction"


def prepared(features: list[str], scale: bool) -> list:
    """Medians for what is missing, constant features dropped, the rest standardised if asked for."""
    filled = [f"{f}__filled" for f in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__all"), VarianceThresholdSelector(featuresCol="__all", outputCol="__varying" if scale else "__x", varianceThreshold=0.0)]
    return stages + [StandardScaler(inputCol="__varying", outputCol="__x", withMean=True)] * scale


def regressors(features: list[str], target: str) -> dict[str, Pipeline]:
    """ols, ridge, elastic_net and boosted_trees."""
    linear = lambda reg, mix: LinearRegression(featuresCol="__x", labelCol=target, predictionCol=OUT, regParam=reg, elasticNetParam=mix, maxIter=50)
    return {
        "ols": Pipeline(stages=[*prepared(features, True), linear(0.0, 0.0)]),
        "ridge": Pipeline(stages=[*prepared(features, True), linear(0.5, 0.0)]),
        "elastic_net": Pipeline(stages=[*prepared(features, True), linear(0.5, 0.5)]),
        "boosted_trees": Pipeline(stages=[*prepared(features, False), GBTRegressor(featuresCol="__x", labelCol=target, predictionCol=OUT, maxIter=3, maxDepth=3, seed=1)]),
    }


def classifiers(features: list[str], target: str, trees: int = 20) -> dict[str, Pipeline]:
    """Logistic regression with an L2 price and a shallow forest, both with classes weighed alike (column weight)."""
    return {
        "logistic": Pipeline(stages=[*prepared(features, True), LogisticRegression(featuresCol="__x", labelCol=target, weightCol="weight", predictionCol=OUT, regParam=0.01, maxIter=50)]),
        "forest": Pipeline(stages=[*prepared(features, False), RandomForestClassifier(featuresCol="__x", labelCol=target, weightCol="weight", predictionCol=OUT, numTrees=trees, maxDepth=3, seed=1)]),
    }


def balanced(df: DataFrame, target: str) -> DataFrame:
    """df with weight: each class counts alike in sum."""
    n = df.groupBy(target).agg(F.count("*").alias("__n"))
    every = n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))  # one row
    return df.join(F.broadcast(n.crossJoin(every)), target).withColumn("weight", F.col("__all") / (F.col("__n") * F.col("__k"))).drop("__n", "__all", "__k")


def with_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """df with fold, by a hash of the group, so that a group is never parted."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(3), group), F.lit(folds)).cast("int"))


def held_out(df: DataFrame, models: dict[str, Pipeline], folds: int) -> DataFrame:
    """The rows of each fold with what each model, fitted to the other folds, predicts for them.

    df is persisted, as every fit passes over it; it stays so for the result, which reads it too.
    """
    df, made = df.persist(), []
    for k in range(folds):
        train, test = df.where(F.col("fold") != k), df.where(F.col("fold") == k)
        if train.isEmpty() or test.isEmpty():
            continue
        for name, model in models.items():
            out = model.fit(train).transform(test)
            score = [vector_to_array("probability")[1].alias("score")] if "probability" in out.columns else []
            made.append(out.select(*df.columns, F.lit(name).alias("model"), OUT, *score))
    if not made:
        raise ValueError("no fold has rows to train on and rows to test")
    out = made[0]
    for d in made[1:]:
        out = out.unionByName(d)
    return out


def errors(predicted: DataFrame, keys: list[str], target: str) -> DataFrame:
    """n, MAE, RMSE and bias of each key."""
    e = F.col(OUT) - F.col(target)
    return predicted.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def chosen(scores: DataFrame, keys: list[str]) -> DataFrame:
    """scores with chosen: the least error of each key, ties by name."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row a model
    return scores.withColumn("chosen", F.row_number().over(w.orderBy(F.round("mae", 9), "model")) == 1)


def forward_chain(df: DataFrame, models: dict[str, Pipeline], target: str, folds: int = 3) -> tuple[str, DataFrame, DataFrame]:
    """(the model that did best on blocks that lie behind its training, its predictions of the locked rows, all scores).

    df has fold (0: only trained on, then in order) and split (development, locked). Locked rows take part in no choice.
    """
    df = df.persist()
    dev, locked = df.where("split = 'development'"), df.where("split = 'locked'")
    made = None
    for k in range(1, folds + 1):
        train, test = dev.where(F.col("fold") < k), dev.where(F.col("fold") == k)
        for name, model in models.items():
            out = model.fit(train).transform(test).select(*df.columns, F.lit(name).alias("model"), OUT)
            made = out if made is None else made.unionByName(out)
    scores = chosen(errors(made, ["model"], target), []).collect()  # a row a model
    best = next(r.model for r in scores if r.chosen)
    return best, models[best].fit(dev).transform(locked).select(*df.columns, F.lit(best).alias("model"), OUT), df.sparkSession.createDataFrame(scores)


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by importance, then name: a forest's own, or the size of a linear model's weights."""
    last = model.stages[-1]
    kept = next(s for s in model.stages if hasattr(s, "selectedFeatures")).selectedFeatures
    size = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    found = dict.fromkeys(features, 0.0) | {features[k]: float(v) for k, v in zip(kept, size, strict=True)}
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


def _digest(features: list[str], target: str, note: dict) -> str:
    return hashlib.sha256(json.dumps([features, target, note], sort_keys=True).encode()).hexdigest()


def _files(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each file of a model, by its place below it: a few rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/model")
    return {r.name: r.sha for r in files.select(F.regexp_extract("path", "/model/(.*)$", 1).alias("name"), F.sha2("content", 256).alias("sha")).collect()}


def freeze(model: PipelineModel, path: str, features: list[str], target: str, **note: object) -> None:
    """Write a fitted model with a manifest of its schema and of its files; a path that is taken is left alone."""
    spark = SparkSession.active()
    model.write().save(f"{path}/model")  # refuses to overwrite
    note = {**note, "files": _files(spark, path)}
    row = {"features": features, "target": target, "note": note, "digest": _digest(features, target, note)}
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def thaw(spark: SparkSession, path: str, features: list[str], target: str) -> PipelineModel:
    """A frozen model, if its manifest and files are what was written and fit the schema at hand; an error in any other case."""
    row = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if row["digest"] != _digest(row["features"], row["target"], row["note"]):
        raise ValueError("the manifest was changed")
    if row["features"] != features or row["target"] != target:
        raise ValueError("the model was fitted to another schema")
    if row["note"]["files"] != _files(spark, path):
        raise ValueError("the model's files were changed")
    return PipelineModel.load(f"{path}/model")


def guarded(predicted: DataFrame, high: str, low: str, bounds: tuple[float, float] = (30.0, 300.0)) -> DataFrame:
    """predicted with status; numbers that cannot be a pressure are withheld: not finite, out of bounds, or high at or below low."""
    ok = F.col(high).between(*bounds) & F.col(low).between(*bounds) & (F.col(high) > F.col(low)) & ~F.isnan(high) & ~F.isnan(low)
    ok = F.coalesce(ok, F.lit(False))
    status = F.when(ok, "estimate").otherwise("withheld")
    return predicted.withColumns({"status": status, high: F.when(ok, F.col(high)), low: F.when(ok, F.col(low))})
