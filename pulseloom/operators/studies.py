"""Study operators: calibration rows, leakage-safe splits, metrics, label upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio


def calibrated(df: DataFrame, keys: list[str], marked: Column, *order: str) -> DataFrame:
    """df with is_calibration: the first marked row of each key, else its first row."""
    w = Window.partitionBy(*keys).orderBy(marked.desc(), *order)
    return df.withColumn("is_calibration", F.row_number().over(w) == 1)


def examples(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows that are no calibration, with baseline_ and delta_ of columns against their key's calibration row."""
    base = {c: F.max(F.when(F.col("is_calibration"), F.col(c))).over(Window.partitionBy(*keys)) for c in columns}
    d = df.withColumns({f"baseline_{c}": x for c, x in base.items()}).where(~F.col("is_calibration"))
    return d.withColumns({f"delta_{c}": F.col(c) - F.col(f"baseline_{c}") for c in columns})


def chronological(df: DataFrame, keys: list[str], *order: str, locked: float = 0.3, least: int = 5) -> DataFrame:
    """df with split: each key's last max(least, ceil(locked * n)) rows are locked, the others development."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    held = F.greatest(F.lit(least), F.ceil(F.lit(locked) * n))
    rank = F.row_number().over(w.orderBy(*order))
    return df.withColumns({"position": rank, "split": F.when(rank > n - held, "locked").otherwise("development")})


def forward_folds(df: DataFrame, keys: list[str], *order: str, folds: int = 3) -> DataFrame:
    """df with fold: rows fall into folds + 1 equal blocks in order, the first of which is only trained on (0)."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    test = F.floor(n / (folds + 1))
    pos = F.row_number().over(w.orderBy(*order)) - 1
    first = n - test * folds
    return df.withColumn("fold", F.when((pos < first) | (test == 0), 0).otherwise(F.floor((pos - first) / F.greatest(test, F.lit(1))) + 1).cast("long"))


def leave_one_out_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """A row a group: the mean of value over all other groups."""
    g = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    every = g.agg(F.sum("s").alias("sum_all"), F.sum("n").alias("n_all"))  # one row
    return g.join(F.broadcast(every)).select(group, F.col("n"), ratio(F.col("sum_all") - F.col("s"), F.col("n_all") - F.col("n")).alias("mean_of_others"))


def error_columns(truth: Column, guess: Column) -> dict[str, Column]:
    """Aggregates: n, MAE, RMSE, bias, standard deviation and correlation of a prediction."""
    e = guess - truth
    return {"n": F.count(e), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "bias": F.avg(e), "std": F.stddev_samp(e), "correlation": F.corr(truth, guess)}


def confusion(truth: Column, guess: Column) -> dict[str, Column]:
    """Aggregates: the four cells, recalls, precision and balanced accuracy of a 0/1 prediction."""
    cell = lambda t, g: F.count_if((truth == t) & (guess == g))
    tp, fn, fp, tn = cell(1, 1), cell(1, 0), cell(0, 1), cell(0, 0)
    recall, other = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {"tp": tp, "fn": fn, "fp": fp, "tn": tn, "recall": recall, "specificity": other, "precision": ratio(tp, tp + fp), "balanced_accuracy": (recall + other) / 2}


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """The area under the ROC curve by average ranks; ties count half. Only distinct scores are ranked together."""
    by_score = df.groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = by_score.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return won.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), ratio(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of changes instead of those of the same key; action tells what became of each row."""
    same = [c for c in table.columns if c not in keys]
    old = table.select(*keys, F.struct(*same).alias("__old"))
    new = changes.select(*keys, F.struct(*same).alias("__new"))
    both = old.join(new, keys, "full")
    action = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "appended").when(F.col("__old") == F.col("__new"), "duplicate_skipped").otherwise("updated")
    return both.select(*keys, *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) for c in same], action.alias("action"))


def ranked(df: DataFrame, *order: Column, partitions: int = 16) -> DataFrame:
    """df with rank, its place from 0 in the whole order: rows are dealt by ranges and numbered within them, so that
    no task sees all of them; one count a range is summed up in the driver's plan. The ranges are kept on disk: dealt a
    second time for the counts, they would be drawn from another sample and end elsewhere."""
    part = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    part = part.withColumns({"__part": F.shiftright("__at", 33), "__nth": F.col("__at").bitwiseAND((1 << 33) - 1)}).persist(StorageLevel.DISK_ONLY)
    sizes = part.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a range
    return part.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__nth")).drop("__at", "__part", "__nth", "__before")


def neighbours(df: DataFrame, keys: list[str], value: str, within: int, near: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """A row a key and distinct value: keys, centre, members, mean and spread of the key's values within reach of it.

    near(centre, value) says what is in reach, by default a difference of at most within as doubles subtract. A range frame
    adds within to the centre instead, and may round to the other side of the limit. Distinct values meet by an equi-join on cells
    that are no narrower than within, a power of two wide, so that division does not round; a key's cells are many tasks.
    """
    near = near or (lambda a, b: F.abs(a - b) <= within)
    width = float(1 << max(within - 1, 0).bit_length())
    some = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__value")).agg(F.count("*").alias("__n"))
    some = some.withColumn("__cell", F.floor(F.least(F.greatest(F.col("__value") / width, F.lit(-1e18)), F.lit(1e18))))
    centres = some.select(*keys, F.col("__value").alias("centre"), F.explode(F.sequence(F.col("__cell") - 1, F.col("__cell") + 1)).alias("__cell"))
    met = centres.join(some, [*keys, "__cell"]).where(near(F.col("centre"), F.col("__value")))
    n, off = F.col("__n"), F.col("__value") - F.col("centre")  # small numbers, which keep their digits squared
    sums = met.groupBy(*keys, "centre").agg(F.sum(n).alias("members"), F.sum(n * off).alias("__s"), F.sum(n * off * off).alias("__ss"))
    shift = F.col("__s") / F.col("members")
    return sums.select(*keys, "centre", "members", (F.col("centre") + shift).alias("mean"), F.sqrt(F.greatest(F.col("__ss") / F.col("members") - shift * shift, F.lit(0.0))).alias("spread"))


def winning_cluster(df: DataFrame, keys: list[str], value: str, within: int, near: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with inside, a row a key: centre, members, runner_up, n).

    The centre is the value with most others within reach, of equals the one with the least spread, then the
    smallest; the runner-up is the best count among what the winner leaves. near is as in neighbours.
    """
    best = Window.partitionBy(*keys).orderBy(F.desc("members"), F.round("spread", 6), "centre")
    win = neighbours(df, keys, value, within, near).withColumn("__rn", F.row_number().over(best)).where("__rn = 1").select(*keys, "centre", "members")
    inside = df.join(win, keys).withColumn("inside", F.abs(F.col(value) - F.col("centre")) <= within).drop("centre", "members")
    rest = neighbours(inside.where("not inside"), keys, value, within, near).groupBy(*keys).agg(F.max("members").alias("runner_up"))
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return inside, win.join(n, keys).join(rest, keys, "left").withColumn("runner_up", F.coalesce("runner_up", F.lit(0)))


def reset_reason(status: Column, before: Column, health: Column) -> Column:
    """Why a device's buffer is cleared at a status that follows another, or null."""
    was = F.coalesce(before, F.lit(""))
    return (
        F.when((status == "moving") & (was != "moving"), "motion_detected")
        .when((status == "still") & ~was.isin("", "still"), "warming_up")
        .when((status == "calibrating") & (was != "calibrating"), "calibrating")
        .when(health, "invalid_timing")
    )
