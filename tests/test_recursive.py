"""Recursive queries against loops over each device's sessions."""

import os

import pytest

from pulseloom.operators import series as se
from pulseloom.plans import kernels
from pulseloom.plans.catalogue import GAP, stream

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def by_session(rows):
    out = []
    for r in sorted(rows, key=lambda r: (r.user_id, r.us, r.event_id)):
        if not out or out[-1][-1].user_id != r.user_id or r.us - out[-1][-1].us > GAP:
            out.append([])
        out[-1].append(r)
    return out


def classified(rows, enter, leave, enter_for, leave_for, warm_up):
    state, above, below, out = None, None, None, {}
    for r in rows:
        if r.us - rows[0].us >= warm_up:
            if r.value > enter:
                above, below = r.us if above is None else above, None
                state = 1 if r.us - above >= enter_for else state
            elif r.value < leave:
                below, above = r.us if below is None else below, None
                state = 0 if r.us - below >= leave_for else state
            else:
                above = below = None
        out[r.event_id] = state
    return out


@tables
def test_queries_restart_at_gaps_alone(spark):
    ema, state = {}, {}
    for rows in by_session(stream(spark, SF).collect()):
        g = rows[0].value
        for r in rows:
            g += 0.01 * (r.value - g)
            ema[r.event_id] = round(g, 9)
        state |= classified(rows, 50.0, 35.0, 200_000, 1_000_000, 2_000_000)
    assert {r.event_id: round(r.ema, 9) for r in kernels.QUERIES["ema_gravity"](spark, SF).collect()} == ema
    assert {r.event_id: r.state for r in kernels.QUERIES["hysteresis"](spark, SF).collect()} == state


def test_state_is_carried_across_batches_and_calendar_bounds(spark):
    bound = 720 * 3600 * 1_000_000 * 657
    df = spark.createDataFrame([(i % 2, i, bound - 3_000_000 + 10_000 * i, float((i * 37 // 90) % 100)) for i in range(600)], "user_id long, event_id long, us long, value double")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        means = {r.event_id: r.ema for r in se.exponential(df, ["user_id"], "us", "event_id", "value", 0.01).collect()}
        states = {r.event_id: r.state for r in se.dwelling(df, ["user_id"], "us", "event_id", "value", 50.0, 35.0, 200_000, 400_000, 500_000).collect()}
    finally:
        spark.conf.set(name, before)
    want, dwelt = {}, {}
    for rows in by_session(df.collect()):
        g = rows[0].value
        for r in rows:
            g += 0.01 * (r.value - g)
            want[r.event_id] = g
        dwelt |= classified(rows, 50.0, 35.0, 200_000, 400_000, 500_000)
    assert means == pytest.approx(want) and states == dwelt and set(states.values()) == {None, 0, 1}
