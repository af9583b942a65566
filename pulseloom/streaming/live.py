"""Live operators: per-device state over streams, with the same rules as their batch twins.

A gap in time, a row at or before the last one, or (where asked for) a step of sequence other than 1 resets a
device; late rows are a fault, never merged. State is a few numbers a device, and the times of a bounded buffer.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION_OUT = "user_id long, event_id long, us long, session long, reset boolean, shown double, mode string"
SESSION_STATE = "us long, event_id long, session long, held double, held_us long"


def live_sessions(events: DataFrame, longest: int, hold: int, sequence: bool = True) -> DataFrame:
    """events (user_id, event_id, us, event_type, value) with session ids and the last valid value held.

    A row before the device's last one, or after a gap longer than longest, starts a new session and clears what
    is held; so does, but for sequence=False, a row of the same time, or one whose event_id is not the next. Error rows
    have no value; a value is held for hold microseconds. A trigger's rows of one device are sorted by time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, last_id, session, held, held_us = state.get if state.exists else (None, None, 0, None, None)
        rows = []
        every = pd.concat(list(batches)).sort_values(["us", "event_id"], kind="stable")
        for e in every.itertuples():
            reset = us is not None and (e.us - us > longest or e.us < us or (sequence and (e.us == us or e.event_id != last_id + 1)))
            if reset:
                session, held, held_us = session + 1, None, None
            if e.event_type != "error":
                held, held_us = float(e.value), int(e.us)
            age = None if held_us is None else e.us - held_us
            mode = "unavailable" if age is None or age > hold else "current" if age == 0 else "held"
            rows.append((key[0], e.event_id, e.us, session, reset, held if mode != "unavailable" else None, mode))
            us, last_id = int(e.us), int(e.event_id)
        state.update((us, last_id, session, held, held_us))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SESSION_OUT.split(", ")])

    return events.groupBy("user_id").applyInPandasWithState(step, SESSION_OUT, SESSION_STATE, "append", GroupStateTimeout.NoTimeout)


RESET_OUT = "user_id long, event_id long, us long, reset string, generation long, buffered long, analysed boolean"
RESET_STATE = "status string, counter long, generation long, first long, tick long, times array<long>"


def live_monitor(events: DataFrame, jump: int, keep: int, period: int) -> DataFrame:
    """events (user_id, event_id, us, status, counter) with what clears a device's buffer, how full it is, and when an analysis is due.

    Motion that begins, ends or cannot be judged, and a health counter that grows by over jump, start a new
    generation with an empty buffer. The buffer holds the samples of the last keep microseconds; an analysis is
    due with the first row of each period once a generation is as old as one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, counter, generation, first, tick, times = state.get if state.exists else (None, None, 0, None, 0, [])
        times, rows = deque(times), []
        for e in pd.concat(list(batches)).sort_values(["us", "event_id"], kind="stable").itertuples():
            was, reset = status or "", None
            if e.status == "moving" and was != "moving":
                reset = "motion_detected"
            elif e.status == "still" and was not in ("", "still"):
                reset = "warming_up"
            elif e.status == "calibrating" and was != "calibrating":
                reset = "calibrating"
            elif counter is not None and e.counter > counter + jump:
                reset = "invalid_timing"
            if reset:
                generation, first, tick, times = generation + 1, None, 0, deque()
            first = int(e.us) if first is None else first
            times.append(int(e.us))
            while times[0] < e.us - keep:
                times.popleft()
            now = (int(e.us) - first) // period
            rows.append((key[0], e.event_id, e.us, reset, generation, len(times), now > tick))
            status, counter, tick = e.status, int(e.counter), now
        state.update((status, counter, generation, first, tick, list(times)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESET_OUT.split(", ")])

    return events.groupBy("user_id").applyInPandasWithState(step, RESET_OUT, RESET_STATE, "append", GroupStateTimeout.NoTimeout)


def live_windows(events: DataFrame, width: str = "8 hours", step: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Counts and means of sliding windows of events (ts, user_id, value), each once, when its time is past."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("user_id", F.col("window.start").alias("start"), "n", "mean")
