"""Two live streams joined: against loops, and as streams against tables."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulseloom.streaming.paired import Rules, checked_windows, paired

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc).replace(tzinfo=None)
OPTICAL, MOTION = "device long, ts timestamp, seq long, red double, ir double", "device long, ts timestamp, seq long, x double, y double, z double"
RULES = Rules(width=800, step=400, late=200, reach=40, longest_gap=40, completeness=0.9)


def samples(seed=1, devices=(1, 2), n=400):
    """Optical rows each 10 ms and motion rows each 8 ms, with gaps, lost rows and silence."""
    r = random.Random(seed)
    optical, motion = [], []
    for d in devices:
        gone = (900, 1000) if d == 1 else (2000, 2500)
        for rows, every, lost in ((optical, 10, 0.004), (motion, 8, 0.004)):
            for i in range(n * 10 // every):
                t = 3 + i * every
                if r.random() < lost or gone[0] <= t < gone[1] and (rows is motion or t % 400 < 90):
                    continue
                at = T0 + timedelta(milliseconds=t)
                v = [float(r.randrange(100)) for _ in range(3)]
                rows.append((d, at, i, v[0], v[1]) if rows is optical else (d, at, i, *v))
    return optical, motion


def brute(optical, motion, rules):
    ms = lambda t: round((t - T0).total_seconds() * 1000)
    out, pairs = {}, {}
    for d in {o[0] for o in optical}:
        o, m = (sorted((ms(x[1]), *x[2:]) for x in rows if x[0] == d) for rows in (optical, motion))
        for s in o:
            a = [x for x in m if s[0] - rules.reach <= x[0] <= s[0]]
            b = [x for x in m if s[0] <= x[0] <= s[0] + rules.reach]
            if a and b:
                a, b = max(a), min(b)
                w = (s[0] - a[0]) / (b[0] - a[0]) if b[0] > a[0] else 0
                pairs[d, s[1]] = tuple(p + (q - p) * w for p, q in zip(a[2:], b[2:], strict=True))
            else:
                pairs[d, s[1]] = None
        last = max([x[0] for x in o + m])
        for start in range(-rules.width, last + 1, rules.step):
            end = start + rules.width
            x, y = ([s for s in rows if start <= s[0] < end] for rows in (o, m))
            if not x and not y:
                continue
            why, full = set(), []
            for k, rows in (("ppg", x), ("imu", y)):
                dt = sorted(b[0] - a[0] for a, b in zip(rows, rows[1:], strict=False))
                mid = (dt[(len(dt) - 1) // 2] + dt[len(dt) // 2]) / 2 if dt else None
                full.append(min(1.0, len(rows) / max(rules.width / mid, 1)) if mid else 0.0)
                if any(b[1] - a[1] != 1 for a, b in zip(rows, rows[1:], strict=False)):
                    why.add(f"{k}_sequence_fault")
                if len(rows) < 2 or dt[-1] > rules.longest_gap:
                    why.add(f"{k}_timestamp_gap")
                if full[-1] < rules.completeness:
                    why.add(f"incomplete_{k}_window")
                if mid is None or rows[0][0] - start > mid or end - rows[-1][0] > mid:
                    why.add("outside_common_sensor_coverage")
            if any(pairs[d, s[1]] is None for s in x):
                why.add("insufficient_imu_interpolation_coverage")
            out[d, start] = (len(x), len(y), *full, ";".join(sorted(why)))
    return pairs, out


def shown(rows):
    zero = int(T0.replace(tzinfo=timezone.utc).timestamp() * 1e6)
    return {(r.device, (r.start_us - zero) // 1000): (r.ppg_samples, r.imu_samples, r.ppg_completeness, r.imu_completeness, r.reasons) for r in rows}


@pytest.fixture(scope="module")
def tables(spark):
    optical, motion = samples()
    return optical, motion, spark.createDataFrame(optical, OPTICAL), spark.createDataFrame(motion, MOTION)


def test_pairs_and_windows_against_loops(tables):
    optical, motion, o, m = tables
    pairs, windows = brute(optical, motion, RULES)
    got = {(r.device, r.seq): None if r.x is None else (r.x, r.y, r.z) for r in paired(o, m, RULES).collect()}
    assert got.keys() == pairs.keys() and all((v is None) == (pairs[k] is None) and (v is None or v == pytest.approx(pairs[k])) for k, v in got.items())
    rows = checked_windows(o, m, RULES).collect()
    assert shown(rows) == windows
    reasons = {x for v in windows.values() for x in v[-1].split(";")}
    assert len(reasons) == 9 and "" in reasons  # every reason, and windows without one
    one = next(r for r in rows if not r.reasons)
    assert [s.us for s in one.samples] == sorted(s.us for s in one.samples) and all(s.x is not None for s in one.samples)


def test_streams_equal_the_tables(spark, tables, tmp_path):
    optical, motion, o, m = tables
    end = T0 + timedelta(milliseconds=1_000_000)
    for k in range(4):  # each batch has a second of both; the last rows push the watermark past all windows
        for name, df, schema, more in (("o", o, OPTICAL, (99, end, 0, 0.0, 0.0)), ("m", m, MOTION, (99, end, 0, 0.0, 0.0, 0.0))):
            part = df.where((F.col("ts") >= F.lit(T0 + timedelta(seconds=k))) & (F.col("ts") < F.lit(T0 + timedelta(seconds=k + 1))))
            part.coalesce(1).write.parquet(str(tmp_path / name / f"part={k}"))
            if k == 3:
                spark.createDataFrame([more], schema).coalesce(1).write.parquet(str(tmp_path / name / "part=9"))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
    live = checked_windows(read("o", OPTICAL), read("m", MOTION), RULES)
    q = live.writeStream.format("memory").queryName("paired_live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    held = [p for p in q.recentProgress][-1]
    q.stop()
    got = shown(r for r in spark.table("paired_live").collect() if r.device != 99)
    assert got == shown(checked_windows(o, m, RULES).collect())
    assert sum(s.numRowsTotal for s in held.stateOperators) < 50  # what is past the watermark is not held
