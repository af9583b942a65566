"""A ridge model of one setup that also learns from others: partial pooling, forward selection, and one evaluation.

Every feature stands twice: shared by all setups, and once more for each setup but the target's, as a deviation that is
zero elsewhere. The penalty on deviations lets other setups speak where they agree with the target and keeps them apart
where they do not. Penalties are chosen on later rows of the target setup alone, from all rows that are earlier; the
folds' moments are running sums over time intervals, so no fold reads the rows again. Locked rows are judged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gram
from .orderstats import numbered
from .series import BLOCK


@dataclass(frozen=True)
class Design:
    """What is fitted: columns of the rows, the setup that counts, and the choices."""

    setup: str
    target_setup: object
    time: str
    tie: str
    features: tuple[str, ...]
    targets: tuple[str, ...]
    setups: tuple = ()
    alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)
    splits: int = 4
    least: int = 10
    #: Of models that are equally good, to nine digits, the one of fewer columns counts; else the last bits and then the one of more.
    simpler: bool = False

    @property
    def others(self) -> tuple:
        return tuple(s for s in self.setups if s != self.target_setup)

    @property
    def columns(self) -> list[str]:
        """Shared features, then those of each other setup, then its own level."""
        return [*self.features, *(f"{f}__of_{s}" for s in self.others for f in (*self.features, "level"))]

    @property
    def sets(self) -> dict[str, list[str]]:
        return {"pooled": list(self.features), "partial": self.columns}


def designed(df: DataFrame, d: Design) -> DataFrame:
    """df with the deviation columns; rows of a setup that is not named are refused by leaving them out."""
    made = {}
    for s in d.others:
        here = F.col(d.setup) == F.lit(s)
        made |= {f"{f}__of_{s}": F.when(here, F.col(f).cast("double")).otherwise(F.when(F.col(f).isNotNull(), 0.0)) for f in d.features}
        made[f"level__of_{s}"] = here.cast("double")
    return df.where(F.col(d.setup).isin(*d.setups)).withColumns(made)


def forward(df: DataFrame, d: Design, block: int = BLOCK) -> tuple[DataFrame, list[int]]:
    """(the target setup's rows that are scored, with their fold, and each fold's boundary in time).

    Of n rows in order the last splits * (n div (splits + 1)) are scored, in as many runs of equal length.
    """
    own = numbered(df.where(F.col(d.setup) == F.lit(d.target_setup)).withColumn("__all", F.lit(0)), ["__all"], d.time, d.tie, "__at", block).drop("__all")
    n = own.count()
    if n < max(d.least, d.splits + 1):
        raise ValueError(f"{n} rows of the target setup are too few")
    size = n // (d.splits + 1)
    first = n - d.splits * size
    scored = own.where(F.col("__at") >= first).withColumn("fold", F.floor((F.col("__at") - first) / size).cast("int")).drop("__at")
    bounds = {r.fold: r.t for r in scored.groupBy("fold").agg(F.min(d.time).alias("t")).collect()}  # a row a fold
    return scored, [bounds[k] for k in range(d.splits)]


def folds_of(rows: DataFrame, bounds: list[int], d: Design, values: list[str], centre: dict[str, float]) -> DataFrame:
    """fold, variant and the sums of all rows before the fold's boundary: all setups (combined), or the target's alone."""
    interval = sum((F.when(F.col(d.time) >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))
    per = gram.moments(rows.withColumns({"__interval": interval, "__own": F.col(d.setup) == F.lit(d.target_setup)}), ["__interval", "__own"], values, centre)
    width = (len(values) + 1) * (len(values) + 2) // 2
    both = per.select("__interval", F.lit("combined").alias("variant"), "sums").unionByName(per.where("__own").select("__interval", F.lit("alone").alias("variant"), "sums"))
    # a row an interval and kind of setup reaches every later fold
    later = both.withColumn("fold", F.explode(F.sequence(F.col("__interval"), F.lit(len(bounds))))).where(F.col("fold") <= len(bounds))
    return later.groupBy("variant", "fold").agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))


def selected(df: DataFrame, d: Design, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(scores, models): the mean error of each variant, model, target and penalty on later rows, whether it is chosen,
    and the models of each penalty fitted to all rows, of which the chosen are marked."""
    values = [*d.columns, *d.targets]
    rows = gram.complete(designed(df, d), values)
    scored, bounds = forward(rows, d, block)
    centre = gram.means(rows, values)
    sums = folds_of(rows, bounds, d, values, centre).persist()  # a row a fold and variant
    said = models = None
    for alpha in d.alphas:
        m = gram.ridge_models(sums, ["variant", "fold"], d.columns, list(d.targets), d.sets, centre, alpha).withColumn("alpha", F.lit(float(alpha)))
        models = m if models is None else models.unionByName(m)
    on = models.where(F.col("fold") < d.splits).withColumn("model", F.concat_ws("/", "variant", "model", F.col("alpha").cast("string"), "target"))
    said = gram.predicted(scored, on, ["fold"], d.columns)
    truth = F.coalesce(*(F.when(F.col("target") == t, F.col(t)) for t in d.targets))
    part = F.split("model", "/")
    scores = said.groupBy(part[0].alias("variant"), part[1].alias("model"), "target", part[2].cast("double").alias("alpha")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - truth)).alias("mae"))
    rank = (F.round("mae", 9), "alpha", F.desc("variant"), F.desc("model")) if d.simpler else ("mae", "alpha", F.desc("variant"), "model")
    best = F.row_number().over(Window.partitionBy("target").orderBy(*rank))
    scores = scores.withColumn("chosen", best == 1)
    last = models.where(F.col("fold") == d.splits).drop("fold")
    return scores, last.join(scores.select("variant", "model", "target", "alpha", "mae", "chosen"), ["variant", "model", "target", "alpha"])


def judged_once(locked: DataFrame, models: DataFrame, d: Design, cutoff: int, path: str | None = None) -> DataFrame:
    """The chosen models on locked rows of the target setup, all later than cutoff, beside the targets' own baseline.

    With a path the rows are written there; a second evaluation on the same path is refused.
    """
    rows = designed(locked, d).where(F.col(d.setup) == F.lit(d.target_setup))
    early = rows.where(F.col(d.time) <= F.lit(cutoff)).limit(1).count()
    if early:
        raise ValueError("locked rows must be later than every row that was fitted to")
    out = gram.predicted(rows, models.where("chosen"), [], d.columns)
    truth = F.coalesce(*(F.when(F.col("target") == t, F.col(t)) for t in d.targets))
    out = out.withColumn("error", F.col("predicted") - truth)
    if path is None:
        return out
    out.write.mode("errorifexists").parquet(path)
    return locked.sparkSession.read.parquet(path)


def summary(judged: DataFrame) -> DataFrame:
    """n, mae, rmse, bias and the largest error of each target."""
    e = F.col("error")
    return judged.groupBy("target").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("worst"))
