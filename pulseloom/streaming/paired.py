"""Two live streams as one: optical rows with motion at their very times, and causal windows over both, checked.

optical has device, ts, seq, red and ir; motion has device, ts, seq, x, y and z. All of it is declared on DataFrames, so
that the same functions serve streams, whose watermarks bound and evict what is held, and tables. A window is emitted
once, when the watermark is past its end; rows later than that are dropped by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Rules:
    """Times in milliseconds."""

    width: int = 8000
    step: int = 4000
    late: int = 2000
    #: How far a motion row may lie from the optical row that it is interpolated to.
    reach: int = 40
    longest_gap: int = 40
    completeness: float = 0.95



def paired(optical: DataFrame, motion: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """optical with x, y and z, linear between the motion rows before and behind, null where one lacks within reach.

    The interval join holds a row of either side for reach and the lateness allowed, no longer.
    """
    span = F.expr(f"interval {rules.reach} milliseconds")
    late = f"{rules.late} milliseconds"
    o = optical.withWatermark("ts", late)
    m = motion.select(F.col("device").alias("m_device"), F.col("ts").alias("m_ts"), *AXES).withWatermark("m_ts", late)
    near = (F.col("device") == F.col("m_device")) & (F.col("m_ts") >= F.col("ts") - span) & (F.col("m_ts") <= F.col("ts") + span)
    met = o.join(m, near, "left_outer")
    row = F.struct("m_ts", *AXES)
    before = F.max_by(row, F.when(F.col("m_ts") <= F.col("ts"), F.col("m_ts")))
    behind = F.min_by(row, F.when(F.col("m_ts") >= F.col("ts"), F.col("m_ts")))
    one = met.groupBy("ts", "device", "seq", "red", "ir").agg(before.alias("a"), behind.alias("b"))
    a, b, t = F.unix_micros("a.m_ts"), F.unix_micros("b.m_ts"), F.unix_micros("ts")
    both = F.col("a.m_ts").isNotNull() & F.col("b.m_ts").isNotNull()

    def between(c: str) -> Column:
        line = F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * (t - a) / F.nullif(b - a, F.lit(0))
        return F.when(both, F.coalesce(line, F.col(f"a.{c}").cast("double"))).alias(c)

    return one.select("ts", "device", "seq", "red", "ir", *map(between, AXES))


def checked_windows(optical: DataFrame, motion: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Sliding windows [start, start + width) of the paired streams: counts, completeness, reasons against them, and samples.

    samples are the optical rows in order with the motion at their times. Reasons, sorted and joined by ";":
    a step of seq other than one, or of time of zero; too few rows for the stream's own median step; a step that is too
    long; an edge of the window that either stream does not reach; an optical row that motion does not bracket.
    """
    o = paired(optical, motion, rules).withColumn("kind", F.lit("ppg"))
    m = motion.withWatermark("ts", f"{rules.late} milliseconds").select("ts", "device", "seq", F.lit(None).cast("double").alias("red"), F.lit(None).cast("double").alias("ir"), *(F.col(c).cast("double").alias(c) for c in AXES), F.lit("imu").alias("kind"))
    rows = o.select("ts", "device", "seq", *(F.col(c).cast("double").alias(c) for c in ("red", "ir")), *AXES, "kind").unionByName(m)
    sample = F.struct(F.unix_micros("ts").alias("us"), "seq", "red", "ir", *AXES)
    held = rows.groupBy(F.window("ts", f"{rules.width} milliseconds", f"{rules.step} milliseconds").alias("window"), "device").agg(
        *(F.sort_array(F.collect_list(F.when(F.col("kind") == k, sample))).alias(k) for k in ("ppg", "imu"))
    )
    return judged(held.select("device", F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), "ppg", "imu"), rules)


def judged(held: DataFrame, rules: Rules) -> DataFrame:
    """Windows with sorted samples (ppg, imu) and their verdict."""
    step = lambda c, f: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: b[f] - a[f])
    d = held
    for k in ("ppg", "imu"):
        d = d.withColumns({f"{k}_dt": step(k, "us"), f"{k}_dseq": step(k, "seq")})
        n = F.size(f"{k}_dt")
        ordered = F.array_sort(f"{k}_dt")
        mid = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
        d = d.withColumn(f"{k}_step", F.when(n > 0, mid))
        full = F.greatest(F.lit(rules.width * 1000.0) / F.col(f"{k}_step"), F.lit(1.0))
        d = d.withColumns({f"{k}_samples": F.size(k).cast("long"), f"{k}_completeness": F.when(F.col(f"{k}_step") > 0, F.least(F.lit(1.0), F.size(k) / full)).otherwise(0.0)})
    edge = lambda k: (F.get(k, F.lit(0))["us"] - F.col("start_us") > F.col(f"{k}_step")) | (F.col("end_us") - F.element_at(k, -1)["us"] > F.col(f"{k}_step"))
    some = lambda k: F.size(k) > 0
    reasons = {
        "imu_sequence_fault": F.exists("imu_dseq", lambda x: x != 1) | F.exists("imu_dt", lambda x: x <= 0),
        "imu_timestamp_gap": (F.size("imu") < 2) | F.exists("imu_dt", lambda x: x > rules.longest_gap * 1000),
        "incomplete_imu_window": F.col("imu_completeness") < rules.completeness,
        "incomplete_ppg_window": F.col("ppg_completeness") < rules.completeness,
        "insufficient_imu_interpolation_coverage": F.exists("ppg", lambda s: s["x"].isNull()),
        "outside_common_sensor_coverage": ~some("ppg") | ~some("imu") | F.coalesce(F.when(some("ppg"), edge("ppg")), F.lit(True)) | F.coalesce(F.when(some("imu"), edge("imu")), F.lit(True)),
        "ppg_sequence_fault": F.exists("ppg_dseq", lambda x: x != 1) | F.exists("ppg_dt", lambda x: x <= 0),
        "ppg_timestamp_gap": (F.size("ppg") < 2) | F.exists("ppg_dt", lambda x: x > rules.longest_gap * 1000),
    }
    why = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in reasons.items()))), ";")
    return d.select("device", "start_us", "end_us", "ppg_samples", "imu_samples", "ppg_completeness", "imu_completeness", why.alias("reasons"), F.col("ppg").alias("samples"))
