"""Admission rules as column expressions: sensor health, streams, signal quality, labels, live gates.

A rule gives sorted reason names joined by semicolons, or one class name. None of them sees a label or a
prediction unless that is its argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import reasons

#: Raw accelerometer counts to g, and g to metres per second squared.
G_PER_COUNT, METRES = 0.0039, 9.80665
#: The converter's ends, with a margin: counts there are clipped.
CLIP_LOW, CLIP_HIGH = 16, (1 << 18) - 17
REJECTED_STATUSES = ["reject", "rejected", "unusable", "poor", "pending_manual_review", "uncertain"]


def joined(parts: list[Column]) -> Column:
    """The sorted distinct entries that are not null, joined by semicolons."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))), ";")


def axes_magnitude(x: Column, y: Column, z: Column) -> Column:
    """Acceleration in metres per second squared, from raw counts of three axes."""
    return F.sqrt(x * x + y * y + z * z) * F.lit(G_PER_COUNT * METRES)


def counter_reasons(counters: dict[str, Column]) -> Column:
    """Of health counters as text: blank ones are skipped, others must be numbers, finite and zero."""
    parts = []
    for name, c in counters.items():
        v = F.expr("null").cast("string")
        number = c.try_cast("double")
        bad = number.isNull() | F.isnan(number) | (number < 0) | (number == float("inf"))
        v = F.when(c.isNull() | (c == ""), v).when(bad, f"invalid_sensor_health_counter:{name}").when(number > 0, F.concat(F.lit(f"sensor_health_error:{name}="), number.cast("long").cast("string")))
        parts.append(v)
    return joined(parts)


def counter_warnings(counters: dict[str, Column]) -> Column:
    """The names of the counters that are missing."""
    return joined([F.when(c.isNull() | (c == ""), f"missing_sensor_health_counter:{n}") for n, c in counters.items()])


def unknown_counter_reasons(counters: dict[str, Column]) -> Column:
    """As counter_reasons(), but a counter that is missing or no number rejects too."""
    parts = []
    for name, c in counters.items():
        number = c.try_cast("double")
        parts.append(F.when(number.isNull(), f"unknown_sensor_health:{name}").when((number != 0) | F.isnan(number), f"sensor_health:{name}"))
    return joined(parts)


def stream_reasons(n: Column, odd_steps: Column, backward: Column, long_gaps: Column) -> Column:
    """Of a stream's counts: too short, steps of sequence other than 1, times that do not rise, gaps."""
    some = reasons(("sequence_discontinuity", odd_steps > 0), ("nonmonotonic_time", backward > 0), ("timestamp_gap", long_gaps > 0))
    return F.when(n < 2, "missing_or_empty_stream").otherwise(some)


def analysis_quality(missing: Column, timing: Column, peaks: Column, bpm: Column, off: Column, span: Column, warned: Column) -> tuple[Column, Column]:
    """(reject, borderline or usable; why) of an analysed trial."""
    no_rate = bpm.isNull() | ~bpm.between(40, 180)
    doubts = F.array_join(F.array_compact(F.array(F.when(timing == "borderline", "timing"), F.when(warned, "warnings"), F.when(F.abs(off) > 10, "cuff"), F.when(span < 1000, "span"))), ";")
    why = F.when(missing > 0, "missing_samples").when(timing == "reject", "timing").when(no_rate, "rate").when(peaks < 3, "peaks").otherwise(doubts)
    cls = F.when((missing > 0) | (timing == "reject") | no_rate | (peaks < 3), "reject").when(doubts != "", "borderline").otherwise("usable")
    return F.coalesce(cls, F.lit("reject")), why


def effective_warnings(timing: Column, warnings: Column) -> tuple[Column, Column]:
    """(warnings that count, those set aside): warnings on timestamps do not count where timing is good or usable."""
    lenient = F.coalesce(timing.isin("good", "usable"), F.lit(False))
    legacy = lambda w: F.lower(w).contains("timestamp")
    return F.filter(warnings, lambda w: ~(lenient & legacy(w))), F.filter(warnings, lambda w: lenient & legacy(w))


def warning_list(text: Column) -> Column:
    """Warnings as an array from one text, a list parted by bars, or nothing."""
    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(text, "\\|"), lambda x: F.trim(x)), lambda x: x != ""))


def signal_decision(severity: Column, known: Column, contact: Column, clipped: Column, checks: list[Column], least_contact: float, most_clipped: float) -> tuple[Column, Column]:
    """(recoverability, eligible) of a window's signal, in the order contact, severe motion, all checks."""
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.coalesce(c, F.lit(False))
    lost = F.coalesce((contact < least_contact) | (clipped > most_clipped), F.lit(False))
    state = (
        F.when(~known | (severity == "unknown"), "uncertain")
        .when(lost | (severity == "severe"), "unrecoverable")
        .when(ok & (severity == "stationary"), "preserved")
        .when(ok, "potentially_recoverable")
        .otherwise("uncertain")
    )
    return state, state.isin("preserved", "potentially_recoverable")


def suggested_label(clipped: Column, step: Column, spread: Column, moving: Column, morphology: Column) -> Column:
    """What a reviewer is offered: contact before motion before clean."""
    return (
        F.when((clipped > 0) | (step > F.greatest(F.lit(1000.0), F.lit(6.0) * spread)), "contact_corrupted")
        .when(moving, "motion_corrupted")
        .when(morphology, "clean")
        .otherwise("uncertain")
    )


def reference_usable(kind: Column, valid: Column, aligned: Column, ref_start: Column, start: Column, end: Column, ref_end: Column, high: Column, low: Column, digest: Column) -> Column:
    """Whether a continuous reference covers a window and can be: anything unknown is a no."""
    all_of = (kind == "continuous") & valid & aligned & (ref_start <= start) & (start < end) & (end <= ref_end) & (low > 0) & (low < high) & (F.length(digest) == 64)
    return F.coalesce(all_of, F.lit(False))


def role_of(name: Column) -> Column:
    """The role that the last part of an identity names."""
    last = F.lower(F.regexp_extract(name, "([A-Za-z]+)[0-9_]*$", 1))
    return F.when(last.isin("recovery", "stationary", "calibration"), last).otherwise("other")


def values_agree(a: Column, b: Column) -> Column:
    """Whether two values given as text agree: as numbers within 1e-9, else letter by letter; a blank one agrees with all."""
    x, y = a.try_cast("double"), b.try_cast("double")
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return blank(a) | blank(b) | F.coalesce(F.abs(x - y) <= 1e-9, F.trim(a) == F.trim(b))


def live_gate(age: Column, status: Column, stale_after: int) -> Column:
    """Why a live estimate must not be shown, or null."""
    return (
        F.when(age.isNull(), "motion_unknown")
        .when(age > stale_after, "motion_stale")
        .when(status == "moving", "motion_detected")
        .when(status == "calibrating", "calibrating")
        .when(status == "unavailable", "imu_unavailable")
    )


def connection(age: Column, stale_after: int) -> Column:
    return F.when(age.isNull(), "waiting").when(age > stale_after, "stale").otherwise("connected")
