"""A trial's rate from its windows: enough of them, a winning cluster well ahead of the next, and no trend."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import median
from .intervals import covered
from .studies import winning_cluster

#: Rejections that stand for a whole trial, in the order in which equals count.
ARTIFACTS = ("motion_contaminated", "contact_artifact", "poor_contact", "clipping")


@dataclass(frozen=True)
class Gates:
    """The published gates: rates within reach of a centre form its cluster."""

    reach: int = 5
    windows: int = 3
    coverage_s: float = 30.0
    share: float = 0.60
    lead: float = 2.0
    trend: float = 0.15


def consensus(windows: DataFrame, keys: list[str], gates: Gates = Gates()) -> DataFrame:
    """A row a trial: status, bpm, and what decided it, from windows (keys, start_s, end_s, status, bpm).

    Windows count if their status is accepted and they have a rate. Coverage is the union of their time. Without
    enough of either, a trial has the rejection that most of its windows have, if any is an artifact's, else poor quality
    if any window was refused for that, else insufficient_clean_data.
    """
    ok = (F.col("status") == "accepted") & F.col("bpm").isNotNull()
    counted = {f"n_{r}": F.count_if(F.col("status") == r) for r in (*ARTIFACTS, "poor_waveform_quality")}
    every = windows.groupBy(*keys).agg(F.count("*").alias("windows"), F.count_if(ok).alias("accepted"), *(c.alias(k) for k, c in counted.items()))
    good = windows.where(ok).select(*keys, "start_s", "end_s", F.col("bpm").cast("double").alias("bpm"))
    span = covered(good.select(*keys, F.col("start_s").alias("start_us"), F.col("end_s").alias("end_us")), keys).select(*keys, F.col("covered_us").alias("coverage_s"))
    inside, wins = winning_cluster(good, keys, "bpm", gates.reach, lambda a, b: b.between(a - gates.reach, a + gates.reach))
    of = lambda c: F.when(F.col("inside"), c)
    slope = F.regr_slope(of(F.col("bpm")), of((F.col("start_s") + F.col("end_s")) / 2))
    won = inside.groupBy(*keys).agg(F.count_if("inside").alias("winners"), F.round(median(of(F.col("bpm"))), 2).alias("mid"), F.coalesce(F.nanvl(slope, F.lit(0.0)), F.lit(0.0)).alias("trend"))
    d = every.join(span, keys, "left").join(won, keys, "left").join(wins.select(*keys, "runner_up"), keys, "left").na.fill(0, ["coverage_s", "winners", "runner_up", "trend"])
    enough = (F.col("accepted") >= gates.windows) & (F.col("coverage_s") >= gates.coverage_s)
    clear = (F.col("winners") >= F.ceil(F.lit(gates.share) * F.col("accepted"))) & (F.col("winners") >= gates.lead * F.col("runner_up"))
    level = F.abs("trend") <= gates.trend
    most = F.greatest(*(F.col(f"n_{r}") for r in ARTIFACTS))
    first = F.coalesce(*(F.when(F.col(f"n_{r}") == most, r) for r in ARTIFACTS))
    refused = F.when(most > 0, F.when(first == "motion_contaminated", first).otherwise("contact_artifact")).when(F.col("n_poor_waveform_quality") > 0, "poor_waveform_quality").otherwise("insufficient_clean_data")
    status = F.when(~enough, refused).when(clear & level, "usable").otherwise("ambiguous_hr")
    reason = F.when(~enough, "too few windows or too little coverage").when(~clear, "no cluster is well ahead").when(~level, "the rate changes too quickly").otherwise("consensus")
    d = d.withColumns({"status": status, "reason": reason})
    return d.select(*keys, "status", "reason", F.when(F.col("status") == "usable", F.col("mid")).alias("bpm"), "windows", "accepted", "coverage_s", "winners", "runner_up", "trend")
