import math
import random

from pyspark.sql import functions as F

from pulseloom.sources import tables, telemetry


def test_lines_of_every_kind(spark):
    lines = ["12,3400,70000,90000", "imu,7,3410,-1,2,256", "# motion timestamp_ms=5 status=still, activity_g=0.02", "sample_seq,timestamp_ms,red,ir", "1,2,3", "1,-2,3,4", "imu,7,3410,-1,2,40000", "", "#", "1,2,nan,4", None]
    got = [tuple(r) for r in telemetry.with_kind(spark.createDataFrame([(x,) for x in lines], "line string")).select("kind", "ppg.ir", "imu.x_raw", "status.type", "status.fields").collect()]
    assert [g[0] for g in got] == ["ppg", "imu", "status", "noise", "noise", "noise", "noise", "noise", "noise", "noise", "noise"]
    assert got[0][1] == 90000 and got[1][2] == -1
    assert got[2][3] == "motion" and got[2][4] == {"timestamp_ms": "5", "status": "still", "activity_g": "0.02"}


def test_packets_round_trip(spark):
    ppg = [(100 + 10 * i, 70000 + i, 262143 - i) for i in range(15)]
    imu = [(50 + 8 * i, i - 7, -1024 + i, 1023 - i) for i in range(4)]
    packets = [(1, telemetry.batch_packet(telemetry.PPG_BATCH, 9, 100, ppg)), (2, telemetry.batch_packet(telemetry.IMU_BATCH, 3, 50, imu)), (3, b"\xb3short"), (4, None), (5, b"")]
    got = telemetry.decode_packets(spark.createDataFrame(packets, "id int, packet binary")).orderBy("id", "seq").collect()
    assert [(r.timestamp_ms, r.a, r.b) for r in got if r.id == 1] == ppg and [r.seq for r in got if r.id == 1] == list(range(9, 24))
    assert [(r.timestamp_ms, r.a, r.b, r.c) for r in got if r.id == 2] == imu
    assert [(r.id, r.kind, r.error) for r in got if r.id > 2] == [(3, "error", "batch of a wrong length"), (4, "error", "empty packet"), (5, "error", "empty packet")]


def looped(packets):
    """A device's packets one after another, with the state that a receiver keeps."""
    at, out = {"ppg": None, "imu": None}, []
    for i, p in packets:
        family, count = p[0] & 0xF0, p[0] & 0x0F
        if p[0] in (0x81, 0x82):
            kind = "ppg" if p[0] == 0x81 else "imu"
            seq, ms, *v = telemetry.struct.unpack("<IIII" if kind == "ppg" else "<IIhhh", p[1:])
            at[kind] = (seq, ms)
            out.append((i, kind, seq, ms, *v))
            continue
        kind = "ppg" if family in (0xB0, 0x90) else "imu"
        placed = family in (0xB0, 0xC0)
        bits = telemetry.Bits(p[9:] if placed else p[1:])
        if placed:
            seq, ms = telemetry.struct.unpack_from("<II", p, 1)
            at[kind] = (seq - 1, ms)
        if at[kind] is None:
            out += [(i, "error")] * count
            continue
        for k in range(count):
            v = [bits.take(18) for _ in range(2)] if kind == "ppg" else [bits.take(11, True) for _ in range(3)]
            step = 0 if placed and not k else 8 + bits.take(3)
            at[kind] = (at[kind][0] + 1, at[kind][1] + step)
            out.append((i, kind, *at[kind], *v))
    return out


def test_relative_packets_against_a_receiver(spark):
    r = random.Random(4)
    packets, now = [], {"ppg": 1000, "imu": 2000}
    for i in range(120):
        kind = r.choice(["ppg", "imu"])
        n = r.randrange(1, 16)
        value = (lambda: (r.randrange(1 << 18), r.randrange(1 << 18))) if kind == "ppg" else (lambda: tuple(r.randrange(-1024, 1024) for _ in range(3)))
        samples, before = [], now[kind]
        for _ in range(n):
            now[kind] += r.randrange(8, 16)
            samples.append((now[kind], *value()))
        how = r.random()
        if how < 0.15:
            now[kind] = samples[0][0]
            packets.append((i, telemetry.struct.pack("<BIIII" if kind == "ppg" else "<BIIhhh", 0x81 if kind == "ppg" else 0x82, i * 100, *samples[0])))
        elif how < 0.4:
            packets.append((i, telemetry.batch_packet(telemetry.PPG_BATCH if kind == "ppg" else telemetry.IMU_BATCH, i * 50, samples[0][0], samples)))
        else:
            packets.append((i, telemetry.delta_packet(telemetry.PPG_DELTA if kind == "ppg" else telemetry.IMU_DELTA, before, samples)))
    df = spark.createDataFrame([(d, i, p) for d in (1, 2) for i, p in packets], "device int, i int, packet binary").repartition(3)
    got = telemetry.placed_samples(df, ["device"], "i").collect()
    want = looped(packets)
    for d in (1, 2):
        mine = sorted((r.i, r.kind) if r.kind == "error" else (r.i, r.kind, r.seq, r.timestamp_ms, *[v for v in (r.a, r.b, r.c) if v is not None]) for r in got if r.device == d)
        assert mine == sorted(want)
    assert {r.error for r in got} <= {None, "batch before an absolute sample"}


def test_status_text_whole_and_in_fragments(spark):
    part = lambda n, b: b"\xd0" + n.to_bytes(2, "little") + b
    packets = [b"\x80# stats a=1\n", part(65534, b"# mot"), part(65535, b"ion x=1\n# two"), part(0, b" words\n# lost"), part(7, b"again\nopen"), part(8, b"x" * 4095), part(9, b"yy\nend"), b"\xd0\x01", b"# old text\n"]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(packets)], "device int, i int, packet binary")
    got = sorted(((r.i, r.line, r.error) for r in telemetry.status_lines(df, ["device"], "i").collect()), key=str)
    assert got == [(0, "# stats a=1", None), (2, "# motion x=1", None), (3, "# two words", None), (4, "again", None), (6, None, "status line beyond the safe length")]
    kinds = {r.i: (r.kind, r.error) for r in telemetry.packet_samples(df).collect()}
    assert kinds[7] == ("error", "status fragment of a wrong length") and kinds[8][0] == "text"


def test_report_has_no_nan(spark):
    row = tables.json_report(spark.createDataFrame([(1, math.nan, math.inf, 2.5)], "b int, a double, c double, d double")).first().value
    assert row == '{"a":null,"b":1,"c":null,"d":2.5}'


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("k,v\n1,2\n1,3\n")
    df = tables.read_csv(spark, str(tmp_path / "x.csv"), "k int, v int")
    assert df.agg(F.sum("v")).first()[0] == 5
    try:
        tables.read_csv(spark, str(tmp_path / "x.csv"), "k int, v int", ["k"]).collect()
        raise AssertionError("a repeated key passed")
    except Exception as e:
        assert "repeated key" in str(e)
    out = str(tmp_path / "t")
    tables.write_new(df, out)
    try:
        tables.write_new(df, out)
        raise AssertionError("it was overwritten")
    except Exception as e:
        assert "ALREADY_EXISTS" in str(e).upper()
    assert tables.manifest(spark, str(tmp_path / "x.csv")).first().n_bytes == 12
