"""Records at a steady beat: against a loop, and live against the table, with devices that fall silent."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseloom.streaming import silence as s

T0 = datetime(1970, 1, 1, 0, 1)
P = s.Patience(beat=1000, connection=5000, motion=3000, analysis=12_000, hold=30_000, forget=50_000)
SCHEMA = "device long, ts timestamp, kind string, status string, value double"


def rows(seed=2):
    r, out = random.Random(seed), []
    for d in (1, 2, 3):
        t = r.randrange(0, 5000)
        for i in range(90):
            t += r.choice([1, 400, 900, 1500]) if i % 30 else r.choice([8000, 60_000, 45_000])
            kind = r.choice(["sample", "motion", "motion", "analysis", "analysis", "fault" if r.random() < 0.3 else "sample"])
            status = {"motion": r.choice(["still"] * 5 + ["moving", "calibrating"]), "analysis": "accepted"}.get(kind)
            value = float(r.randrange(80, 140)) if kind == "analysis" and r.random() < 0.7 else None
            out.append((d, T0 + timedelta(microseconds=t), kind, "poor_waveform_quality" if kind == "analysis" and value is None else status, value))
    return out


def us(t):
    return round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)


def loop(data, until, p):
    out = {}
    for d in {x[0] for x in data}:
        mine = sorted((us(x[1]), *x[2:]) for x in data if x[0] == d)
        for tick in range(0, until + 1, p.beat):
            past = [x for x in mine if x[0] <= tick]
            if not past or tick - past[-1][0] > p.forget:
                continue
            begin = max((i for i in range(1, len(past)) if past[i][0] - past[i - 1][0] > p.forget), default=0)
            known = dict.fromkeys(s._FIELDS)
            for x in past[begin:]:
                s.hear(known, *x)
            out[d, tick] = tuple(known.values())
    return out


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3).select("device", F.unix_micros("ts").alias("us"), "kind", "status", "value")


def ticks(df):
    return {(r.device, r.tick_us): tuple(r[2:]) for r in df.collect()}


@pytest.mark.parametrize("block", [7000, 10**9])
def test_ticks_of_a_table_against_a_loop(spark, block):
    data = rows()
    until = us(max(x[1] for x in data)) + 70_000
    want = loop(data, until, P)
    assert ticks(s.ticks_of(table(spark, data), until, P, block)) == want
    assert len({k[0] for k in want}) == 3


def test_live_ticks_go_on_in_silence(spark, tmp_path):
    data = sorted(rows(), key=lambda x: x[1])
    last = data[-1][1]
    for k in range(5):
        some = [x for i, x in enumerate(data) if i * 5 // len(data) == k]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    for k, more in enumerate((20_000, 40_000, 90_000, 90_001)):  # another device alone goes on
        spark.createDataFrame([(99, last + timedelta(microseconds=more), "sample", None, None)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={6 + k}"))
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    live = s.records(s.ticking(files, "0 seconds", P), P)
    q = live.writeStream.format("memory").queryName("ticking").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    states = [sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress]
    q.stop()
    got = {(r.device, r.tick_us): tuple(r[2:]) for r in spark.table("ticking").where("device < 99").collect()}
    # event-time watermarks are whole milliseconds
    until = (us(last) + 90_001) // 1000 * 1000
    want = {(r.device, r.tick_us): tuple(r[2:]) for r in s.records(s.ticks_of(table(spark, data), until, P), P).collect()}
    assert got == want
    quiet = [v for (d, t), v in got.items() if t > us(last)]
    assert {v[0] for v in quiet} >= {"stale"} and {v[2] for v in got.values()} == {"current", "held", "unavailable"}
    assert states[-1] <= 1  # the silent devices are forgotten


def test_gates_come_in_order(spark):
    base = dict(line_us=0, sample_us=0, motion_us=0, motion="still", analysis_us=0, analysis="accepted", estimate=120.0, good_us=0, good=120.0)

    def shown(at, **changed):
        df = spark.createDataFrame([(1, at, *(base | changed).values())], s.TICKS)
        r = s.records(df, P).first()
        return r.status, r["mode"], r.value, r.expired

    assert shown(1000) == ("accepted", "current", 120.0, False)
    assert shown(1000, motion="moving") == ("motion_detected", "held", 120.0, False)
    assert shown(31_000, motion="moving", motion_us=31_000) == ("motion_detected", "unavailable", None, True)
    assert shown(1000, motion="calibrating") == ("calibrating", "unavailable", None, False)
    assert shown(4000) == ("motion_stale", "unavailable", None, False)
    assert shown(6000, motion_us=6000) == ("connection_stale", "unavailable", None, False)
    assert shown(13_000, motion_us=13_000, line_us=13_000) == ("analysis_stale", "unavailable", None, False)
    assert shown(1000, analysis="poor_waveform_quality", estimate=None) == ("poor_waveform_quality", "held", 120.0, False)
    assert shown(1000, analysis="invalid_timing", estimate=None, good=None, good_us=None) == ("invalid_timing", "unavailable", None, False)
    assert shown(1000, **dict.fromkeys(base)) == ("motion_stale", "unavailable", None, False)


def test_ticks_are_not_sorted_with_the_rows(spark, monkeypatch):
    """Rows alone are looked through, also with several at one time and ends of silences; their ticks are made behind that."""
    data = rows() + [(4, T0 + timedelta(microseconds=t), k, "still" if k == "motion" else None, 99.0 if k == "analysis" else None) for t in (10, 1000, 70_000) for k in ("fault", "analysis", "motion")]
    seen, inner = [], s.carried
    monkeypatch.setattr(s, "carried", lambda d, *more: seen.append(d.count()) or inner(d, *more))
    until = us(max(x[1] for x in data)) + 70_000
    want = loop(data, until, P)
    got = s.ticks_of(table(spark, data), until, P, 7000).collect()
    assert {(r.device, r.tick_us): tuple(r[2:]) for r in got} == want and len(got) == len(want)
    assert len(data) < seen[0] < 1.1 * len(data) < len(want)
