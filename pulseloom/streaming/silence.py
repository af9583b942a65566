"""Records of live devices at a steady beat, which go on when a device falls silent.

What a device says arrives as rows (device, ts, kind, status, value): kind is sample, motion, analysis or fault. At
every tick there is a record of what was last heard and how long ago; rules over those ages say what may be shown. The
ages and rules are the same columns for streams and tables. Live, event-time timers fire as the watermark passes,
whether or not the device has sent anything; a device is forgotten after Patience.forget without a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.series import BLOCK, block_of, carried

#: What is known at a tick: when each kind was last heard, and the last estimate that has not been cleared since.
HEARD = "line_us long, sample_us long, motion_us long, motion string, analysis_us long, analysis string, estimate double, good_us long, good double"
TICKS = f"device long, tick_us long, {HEARD}"
STATE = f"{HEARD}, next_us long, pending array<struct<us:long,kind:string,status:string,value:double>>"
_FIELDS = [x.split()[0] for x in HEARD.split(", ")]


@dataclass(frozen=True)
class Patience:
    """Microseconds."""

    beat: int = 1_000_000
    connection: int = 5_000_000
    motion: int = 3_000_000
    analysis: int = 12_000_000
    hold: int = 300_000_000
    forget: int = 600_000_000


#: States in which the last good estimate may be held.
HOLDABLE = ("warming_up", "motion_detected", "contact_artifact", "motion_contaminated", "poor_waveform_quality", "insufficient_clean_data")


def hear(known: dict, us: int, kind: str, status: str | None, value: float | None) -> None:
    """What a row changes. A fault clears what is held; an accepted analysis replaces it."""
    known["line_us"] = us
    if kind == "sample":
        known["sample_us"] = us
    elif kind == "motion":
        known["motion_us"], known["motion"] = us, status
    elif kind == "analysis":
        known["analysis_us"], known["analysis"], known["estimate"] = us, status, value
        if value is not None:
            known["good_us"], known["good"] = us, value
    elif kind == "fault":
        known["good_us"] = known["good"] = known["estimate"] = None
        known["analysis"] = "invalid_timing"


def ticking(rows: DataFrame, late: str, patience: Patience = Patience()) -> DataFrame:
    """TICKS of a stream of rows. A tick is emitted once the watermark is at or past it, from the rows up to it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            *heard, next_us, pending = state.get
            known, pending = dict(zip(_FIELDS, heard, strict=True)), [tuple(p) for p in pending]
        else:
            known, next_us, pending = dict.fromkeys(_FIELDS), None, []
        mark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for b in batches:
                pending += [(int(u), k, None if pd.isna(s) else s, None if pd.isna(v) else float(v)) for u, k, s, v in zip(b.us, b.kind, b.status, b.value, strict=True)]
        pending.sort(key=lambda p: (p[0], p[1], p[2] or "", p[3] is None, p[3] or 0.0))
        if next_us is None and pending:
            next_us = -(-pending[0][0] // patience.beat) * patience.beat
        out, gone, at = [], False, 0
        while next_us is not None and next_us <= mark:
            while at < len(pending) and pending[at][0] <= next_us:
                hear(known, *pending[at])
                at += 1
            if known["line_us"] is not None and next_us - known["line_us"] > patience.forget:
                known, gone = dict.fromkeys(_FIELDS), at == len(pending)
                # behind a long silence the beat begins anew with the next row
                next_us = None if gone else -(-pending[at][0] // patience.beat) * patience.beat
                continue
            out.append((key[0], next_us, *known.values()))
            next_us += patience.beat
        pending = pending[at:]
        if gone and not pending:
            state.remove()
        else:
            state.update((*known.values(), next_us, pending))
            state.setTimeoutTimestamp(max(next_us // 1000, mark // 1000 + 1))
        if not out:
            return
        made = pd.DataFrame(out, columns=["device", "tick_us", *_FIELDS])
        yield made.astype({c: "Int64" for c in made if c.endswith("_us") or c == "device"} | {"estimate": "float64", "good": "float64"})

    given = rows.withWatermark("ts", late).select("device", "ts", F.unix_micros("ts").alias("us"), "kind", "status", "value")
    return given.groupBy("device").applyInPandasWithState(step, TICKS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def ticks_of(rows: DataFrame, until: int, patience: Patience = Patience(), block: int = BLOCK) -> DataFrame:
    """TICKS of a table of rows (device, us, kind, status, value), up to and with the time until.

    What is known changes with rows alone, so rows are ordered and looked through, and each becomes its ticks at the end.
    """
    up = F.col("us") + (patience.beat - 1)
    start = up - F.pmod(up, F.lit(patience.beat))  # the first tick at or behind a row
    order = ["us", "kind", "status", "value"]
    d = rows.select("device", *order).withColumn("__block", block_of(F.col("us"), block))
    # a row's ticks: from it up to the next row of the device, or until the device is forgotten
    nxt = F.lead("us").over(Window.partitionBy("device", "__block").orderBy(*order))
    first = d.groupBy("device", "__block").agg(F.min("us").alias("__first"))
    ahead = first.select(F.col("device").alias("__d"), F.col("__block").alias("__b"), F.lead("__first").over(Window.partitionBy("device").orderBy("__block")).alias("__ahead"))
    d = d.withColumn("__next", nxt).join(ahead, F.col("device").eqNullSafe(F.col("__d")) & (F.col("__block") == F.col("__b")), "left")
    nxt = F.coalesce("__next", "__ahead")
    end = F.least(F.coalesce(nxt, F.lit(1 << 62)) - 1, F.col("us") + patience.forget, F.lit(until))
    # a silence that is too long clears all: it stands as a row of its own, just behind the one before it
    turns = F.when(nxt - F.col("us") > patience.forget, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.select("device", *order, "__block", start.alias("__from"), end.alias("__to"), F.explode(turns).alias("__turn"))
    kind, lost = F.col("kind"), F.col("__turn") == 1
    kept = lambda valid, **columns: (valid | lost, {k: F.when(~lost, c) for k, c in columns.items()})
    us, value, analysis = F.col("us"), F.col("value"), kind == "analysis"
    d = carried(
        d, ["device"], ["us", "__turn", *order[1:]], "__block",
        kept(kind.isin("sample", "motion", "analysis", "fault"), line_us=us),
        kept(kind == "sample", sample_us=us),
        kept(kind == "motion", motion_us=us, motion=F.col("status")),
        kept(analysis, analysis_us=us),
        kept(kind.isin("analysis", "fault"), analysis=F.when(kind == "fault", "invalid_timing").otherwise(F.col("status")), estimate=F.when(analysis, value)),
        kept((analysis & value.isNotNull()) | (kind == "fault"), good_us=F.when(analysis, us), good=F.when(analysis, value)),
    )
    ticks = F.explode(F.sequence("__from", "__to", F.lit(patience.beat)))
    return d.where("__turn = 0 and __from <= __to").select("device", ticks.alias("tick_us"), *_FIELDS)


def records(ticks: DataFrame, patience: Patience = Patience()) -> DataFrame:
    """What may be shown at each tick: status with its reason, mode (current, held, unavailable), value and its age.

    A moving or unknown motion state comes before a stale line, that before a stale analysis, that before the analysis
    itself. A good estimate is held while the status allows it and it is not too old.
    """
    age = lambda c: F.col("tick_us") - F.col(c)
    over = lambda c, limit: F.coalesce(age(c) > limit, F.lit(True))
    some = F.col("estimate").isNotNull()
    status = (
        F.when(over("motion_us", patience.motion), "motion_stale")
        .when(F.col("motion") == "moving", "motion_detected")
        .when(F.coalesce(F.col("motion") != "still", F.lit(True)), F.coalesce("motion", F.lit("imu_unavailable")))
        .when(some & over("line_us", patience.connection), "connection_stale")
        .when(some & over("analysis_us", patience.analysis), "analysis_stale")
        .otherwise(F.coalesce("analysis", F.lit("warming_up")))
    )
    d = ticks.withColumn("status", status)
    now = some & ~F.col("status").isin("motion_stale", "motion_detected", "connection_stale", "analysis_stale") & (F.col("motion") == "still")
    held = F.col("status").isin(*HOLDABLE) & F.col("good").isNotNull() & (age("good_us") <= patience.hold)
    mode = F.when(now, "current").when(held, "held").otherwise("unavailable")
    d = d.withColumn("mode", mode)
    shown = F.when(F.col("mode") == "current", F.col("estimate")).when(F.col("mode") == "held", F.col("good"))
    expired = F.col("status").isin(*HOLDABLE) & (F.col("mode") == "unavailable") & (age("good_us") > patience.hold)
    connection = F.when(over("line_us", patience.connection), "stale").otherwise("connected")
    return d.select("device", "tick_us", connection.alias("connection"), "status", "mode", shown.alias("value"), F.when(F.col("mode") != "unavailable", age("good_us")).alias("age_us"), F.coalesce(expired, F.lit(False)).alias("expired"))
