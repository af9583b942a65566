"""Scans in blocks of time against loops, whatever the blocks."""

import random

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import intervals as iv
from pulseloom.operators import scans
from pulseloom.operators import series as se

GAP = 60
SCHEMA = "user_id long, event_id long, us long, value double"


def series(seed, n=160, devices=(1, 2, None)):
    r, rows = random.Random(seed), []
    for d in devices:
        t = r.randrange(-500, 500)
        for i in range(n):
            t += r.choice([0, 1, 3, 9, 20, 59, 60, 61, 200] if i % 7 == 0 else [1, 2, 5, 12])
            rows.append((d, i, t, r.choice([None, 10.0, 30.0, 40.0, 60.0, 90.0]) if r.random() < 0.6 else (90.0 if (i // 12) % 2 else 5.0)))
    r.shuffle(rows)
    return rows


def in_sessions(rows):
    out = []
    for row in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[2], x[1])):
        if not out or out[-1][-1][0] != row[0] or row[2] - out[-1][-1][2] > GAP:
            out.append([])
        out[-1].append(row)
    return out


def means(rows, alpha):
    out = {}
    for session in in_sessions(rows):
        g = None
        for d, i, _, x in session:
            g = g if x is None else x if g is None else g + alpha * (x - g)
            out[d, i] = g
    return out


def states(rows, enter, leave, enter_for, leave_for, warm_up):
    out = {}
    for session in in_sessions(rows):
        state = over = under = None
        for d, i, t, x in session:
            if t - session[0][2] >= warm_up:
                over = (t if over is None else over) if x is not None and x > enter else None
                under = (t if under is None else under) if x is not None and x < leave else None
                if over is not None and t - over >= enter_for:
                    state = 1
                elif under is not None and t - under >= leave_for:
                    state = 0
            out[d, i] = state
    return out


@pytest.mark.parametrize("block", [7, 50, 333, 10**9])
@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_change_nothing(spark, block, seed):
    rows = series(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.user_id, r.event_id): r.ema for r in scans.exponential(df, ["user_id"], "us", "event_id", "value", 0.1, GAP, block=block).collect()}
    want = means(rows, 0.1)
    assert got.keys() == want.keys() and all((x is None) == (want[k] is None) and (x is None or abs(x - want[k]) < 1e-9) for k, x in got.items())
    for rule in ((50.0, 35.0, 15, 25, 30), (50.0, 35.0, 0, 0, 0), (80.0, 20.0, 40, 70, 200)):
        got = {(r.user_id, r.event_id): r.state for r in scans.dwelling(df, ["user_id"], "us", "event_id", "value", *rule, GAP, block).collect()}
        assert got == states(rows, *rule)
    assert {None, 0, 1} <= set(states(rows, 50.0, 35.0, 15, 25, 30).values())


def test_maps_compose_like_the_rows_themselves():
    """The outline of a block, applied to any state, is what its rows make of it."""
    r = random.Random(4)
    for scan in (scans.Mean(0.3, GAP), scans.Dwelling(50.0, 35.0, 15, 25, 30, GAP)):
        for _ in range(300):
            t, rows = 1000, []
            for _ in range(r.randrange(1, 9)):
                rows.append((t, r.choice([None, 10.0, 40.0, 90.0]), False))
                t += r.choice([1, 8, 20, 61])
            rows = [(1000 - 20 * k, 1.0, True) for k in range(r.randrange(0, 4), 0, -1)] + rows
            entry = r.choice([None, 40.0]) if isinstance(scan, scans.Mean) else [r.choice([None, 0, 1]), *r.choice([(None, None), (990, None), (None, 980)])]
            step, result = scan.outline(1000)
            run = scan.run(entry, 1000)
            for row in rows:
                step(*row)
                shown = run(*row)
            behind = scan.behind(entry, result())
            assert (behind if isinstance(scan, scans.Mean) else behind[0]) == (pytest.approx(shown) if isinstance(scan, scans.Mean) and shown is not None else shown)


@pytest.mark.parametrize("block", [7, 10**9])
def test_holds_and_as_of_joins_look_beyond_their_block(spark, block):
    rows = series(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, last = {}, {}
    for d, i, t, x in sorted(rows, key=lambda x: (x[2], x[1])):
        if x is not None:
            last[d] = (x, t)
        v, at = last.get(d, (None, None))
        age = None if at is None else t - at
        mode = "unavailable" if age is None or age > 30 else "current" if age == 0 else "held"
        want[d, i] = (age, mode, v if mode != "unavailable" else None)
    got = {(r.user_id, r.event_id): (r.age_us, r.mode, r.shown) for r in se.held(df, ["user_id"], "us", "event_id", F.col("value"), 30, block).collect()}
    assert got == want
    updates = [(d, i, t, f"{d}/{i}") for d, i, t, _ in rows if i % 40 == 0]
    got = iv.asof(df, spark.createDataFrame(updates, "user_id long, event_id long, us long, level string"), ["user_id"], "us", "event_id", ["level"], block)
    for r in got.collect():
        before = [u for u in updates if u[0] == r.user_id and u[2] <= r.us]
        assert r.asof_level == (max(before, key=lambda u: (u[2], u[1]))[3] if before else None)


def test_a_device_is_many_tasks(spark):
    df = spark.createDataFrame([(1, i, i * 10, 1.0) for i in range(400)], SCHEMA)
    plan = scans.exponential(df, ["user_id"], "us", "event_id", "value", 0.1, GAP, block=100)
    assert len({r.p for r in plan.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1
    assert all(abs(r.ema - 1.0) < 1e-12 for r in plan.collect())
