"""Column expressions shared by the operators: time, robust statistics and admission rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A median absolute deviation times this estimates a normal standard deviation.
MAD_SCALE = 1.4826


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") if isinstance(ts, str) else F.unix_micros(ts)


def r6(c: str | Column) -> Column:
    """Six decimals, for figures whose last bits depend on the order of a sum."""
    return F.round(c, 6)


def median(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def middle(sorted_values: Column) -> Column:
    """The median of an array that is sorted already."""
    n = F.size(sorted_values)
    return (F.get(sorted_values, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_values, F.floor(n / 2).cast("int"))) / 2


def ratio(a: Column, b: Column) -> Column:
    """a over b, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b)


def finite(c: Column) -> Column:
    """A number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def band(value: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the half-open interval that holds value; null, negative and non-finite: unknown."""
    out = F.lit(names[-1])
    for b, n in reversed(list(zip(bounds, names, strict=False))):
        out = F.when(value < b, n).otherwise(out)
    return F.when(value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf")), "unknown").otherwise(out)


def reasons(*rules: tuple[str, Column]) -> Column:
    """The sorted names of the rules that hold, joined by semicolons; empty where none does."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull()))), ";")


def timing_quality(missing: Column, backward: Column, over_small: Column, over_large: Column, longest: Column, small: float, large: float, reject: float, many: int = 5) -> Column:
    """good, usable, borderline or reject, from the counts of a stream's gaps."""
    return (
        F.when((missing > 0) | (backward > 0) | (over_large > many) | (longest > reject), "reject")
        .when((over_small == 0) & (longest <= small), "good")
        .when((over_large == 0) & (longest <= large), "usable")
        .otherwise("borderline")
    )
