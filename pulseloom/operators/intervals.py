"""Operators on intervals of time: windows, as-of joins, unions, partitions, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import BLOCK, block_of, carried, in_order


def window_starts(time: Column, width: int, step: int) -> Column:
    """The starts of all windows [start, start + width) on the grid of step that hold time: an equi-join key, not a theta join."""
    first = (F.floor((time - width) / step) + 1) * step
    return F.sequence(first.cast("long"), (F.floor(time / step) * step).cast("long"), F.lit(step).cast("long"))


def in_windows(df: DataFrame, time: str, width: int, step: int) -> DataFrame:
    """df with a row for each window that holds it."""
    return df.withColumn("start_us", F.explode(window_starts(F.col(time), width, step)))


def as_intervals(updates: DataFrame, keys: list[str], time: str, tie: str, lasting: int | None = None) -> DataFrame:
    """Each update with the interval [time, end) for which it holds: until the next one, or at most lasting."""
    nxt = F.lead(time).over(in_order(keys, time, tie))
    end = F.coalesce(nxt, F.lit(2**62)) if lasting is None else F.least(F.coalesce(nxt, F.lit(2**62)), F.col(time) + lasting)
    return updates.withColumns({"start_us": F.col(time), "end_us": end})


def asof(df: DataFrame, updates: DataFrame, keys: list[str], time: str, tie: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """df with columns of the latest update of its key at or before its time; no range join.

    Both sides are united and each row looks back within its block of time, and to a row a block for what lies before
    it; of updates at one time the largest tie counts.
    """
    left = df.select(*[F.col(c) for c in df.columns], F.lit(1).alias("__side"), *[F.lit(None).cast(updates.schema[c].dataType).alias(f"__{c}") for c in columns])
    right = updates.select(*[(F.col(c) if c in (*keys, time, tie) else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in df.columns], F.lit(0).alias("__side"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = left.unionByName(right).withColumn("__block", block_of(F.col(time), block))
    found = carried(both, keys, [time, "__side", tie], "__block", (F.col("__side") == 0, {f"asof_{c}": F.col(f"__{c}") for c in columns}))
    return found.where("__side = 1").select(*df.columns, *[f"asof_{c}" for c in columns])


def merged(df: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us") -> DataFrame:
    """The union of each key's intervals as disjoint ones; touching intervals become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    d = d.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_parts"))


def covered(df: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us") -> DataFrame:
    """The length of each key's union of intervals; overlaps count once."""
    return merged(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered_us"), F.count("*").alias("n_islands"))


def exclusive(df: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us") -> DataFrame:
    """df with own_start and own_end: overlapping neighbours are parted half way between their centres."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    mid = F.expr(f"({start} + {end}) div 2")
    d = df.withColumn("__mid", mid)
    left, right = F.lag("__mid").over(w), F.lead("__mid").over(w)
    half = lambda a, b: F.floor((a + b) / 2)
    return d.withColumns({"own_start_us": F.greatest(F.col(start), F.coalesce(half(left, F.col("__mid")), F.col(start))), "own_end_us": F.least(F.col(end), F.coalesce(half(F.col("__mid"), right), F.col(end)))}).drop("__mid")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Pairs of a and b (columns start_us, end_us; b's as b_start_us, b_end_us) that overlap, with the common part.

    Both sides are cut into buckets of time and meet by an equi-join; a pair counts in its first common bucket.
    """
    span = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / bucket)))
    x, y = a.withColumn("__b", span("start_us", "end_us")), b.withColumn("__b", span("b_start_us", "b_end_us"))
    both = x.join(y, [*keys, "__b"]).where((F.col("start_us") < F.col("b_end_us")) & (F.col("end_us") > F.col("b_start_us")))
    both = both.withColumns({"common_start_us": F.greatest("start_us", "b_start_us"), "common_end_us": F.least("end_us", "b_end_us")})
    return both.where(F.col("__b") == F.floor(F.col("common_start_us") / bucket)).drop("__b")
