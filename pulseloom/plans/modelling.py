"""Queries of the model menu. orders are occasions, o_custkey participants; a feature is missing where an occasion has none before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import menu
from ..operators import series as se
from ..operators import studies as st
from .catalogue import ORDERED, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FEATURES, TARGET, FOLDS = ["prior", "trend", "urgent", "month"], "truth", 2


def query(f):
    QUERIES[f.__name__] = f
    return f


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occasions with features from those before them alone."""
    w = se.in_order(["o_custkey"], *ORDERED)
    o = read(spark, sf_dir, "orders")
    prior, other = F.lag("o_totalprice").over(w) / 1000, F.lag("o_totalprice", 2).over(w) / 1000
    return o.select(
        "o_custkey", "o_orderkey", "o_orderdate", prior.alias("prior"), (prior - other).alias("trend"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"),
        F.month("o_orderdate").cast("double").alias("month"), (F.col("o_totalprice") / 1000).alias("truth"),
    )


def _r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def model_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's errors on participants that it was not fitted to, beside leaving the value unchanged, and the choice."""
    d = menu.with_folds(examples(spark, sf_dir), "o_custkey", FOLDS).where("prior is not null")
    p = menu.held_out(d, menu.regressors(FEATURES, TARGET), FOLDS)
    same = d.select(*d.columns, F.lit("zero_change").alias("model"), F.col("prior").alias(menu.OUT))
    return _r6(menu.chosen(menu.errors(p.unionByName(same), ["model"], TARGET), []))


@query
def inner_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice of a model within the training part of each outer fold, by inner folds of whole participants."""
    d = menu.with_folds(examples(spark, sf_dir), "o_custkey", 2).withColumnRenamed("fold", "outer_fold")
    models = {k: v for k, v in menu.regressors(FEATURES, TARGET).items() if k != "boosted_trees"}
    made = None
    for k in range(2):
        inner = d.where(F.col("outer_fold") != k).withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "o_custkey"), F.lit(2)).cast("int"))
        s = menu.chosen(menu.errors(menu.held_out(inner, models, 2), ["model"], TARGET), []).withColumn("outer_fold", F.lit(k))
        made = s if made is None else made.unionByName(s)
    return _r6(made)


@query
def forward_chain_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model chosen on blocks that follow its training in time, then judged once on the locked last occasions."""
    d = st.chronological(examples(spark, sf_dir), ["o_custkey"], *ORDERED)
    w = Window.partitionBy("o_custkey", "split").orderBy(*ORDERED)
    d = d.withColumn("fold", F.least(F.floor((F.row_number().over(w) - 1) / 3), F.lit(2)).cast("int"))
    models = {k: v for k, v in menu.regressors(FEATURES, TARGET).items() if k in ("ols", "ridge")}
    best, locked, scores = menu.forward_chain(d, models, TARGET, 2)
    final = menu.errors(locked, ["model"], TARGET).select(F.lit("locked").alias("part"), "model", "n", "mae", "rmse", "bias")
    return _r6(scores.select(F.lit("development").alias("part"), "model", "n", "mae", "rmse", "bias").unionByName(final)).withColumn("chosen", F.col("model") == best)


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = examples(spark, sf_dir).where("prior is not null").withColumn("usable", (F.abs(F.col("prior") - F.col("truth")) < 60).cast("int"))
    return menu.balanced(menu.with_folds(d, "o_custkey", 2), "usable")


@query
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classifiers of usable occasions on held-out participants: cells, recalls, balanced accuracy, and the gate."""
    p = menu.held_out(_classes(spark, sf_dir), menu.classifiers(FEATURES, "usable"), 2)
    m = p.groupBy("model").agg(*[c.alias(n) for n, c in st.confusion(F.col("usable"), F.col(menu.OUT)).items()])
    return _r6(m).withColumn("accepted", F.coalesce((F.col("balanced_accuracy") >= 0.8) & (F.col("recall") >= 0.8) & (F.col("specificity") >= 0.9), F.lit(False)))


@query
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a forest of all participants goes by."""
    model = menu.classifiers(FEATURES, "usable")["forest"].fit(_classes(spark, sf_dir))
    rows = [(n, round(v, 6), i + 1) for i, (n, v) in enumerate(menu.importance(model, FEATURES))]
    return spark.createDataFrame(rows, "feature string, importance double, place int")


@query
def guarded_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pressures predicted by one fit each; pairs that cannot be are withheld."""
    d = examples(spark, sf_dir).where("prior is not null").withColumn("low_truth", F.col("truth") * 0.6)
    high = menu.regressors(FEATURES, "truth")["ridge"].fit(d).transform(d).select("o_orderkey", *FEATURES, "low_truth", F.col(menu.OUT).alias("sbp"))
    both = menu.regressors(FEATURES, "low_truth")["ols"].fit(high).transform(high).select("o_orderkey", "sbp", (F.col(menu.OUT) + F.col("urgent") * 40).alias("dbp"))
    return menu.guarded(both, "sbp", "dbp").groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(F.col("sbp") - F.col("dbp")), 4).alias("pulse_pressure"))
