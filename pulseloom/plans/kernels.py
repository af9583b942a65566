"""Queries beyond SQL: recursive filters, signal kernels, models, parsers of binary data, streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp, rates, waves
from ..functions.expr import r6
from ..operators import models, scans
from ..operators import series as se
from ..sources import telemetry
from .catalogue import E_SQL, GAP, KEY, PRED_SQL, predictions, read, stream
from .signals import RATE, over_matrix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: What SQL can say of them after all: round trips, recursions, closed forms.
SQL: dict[str, str] = {}
SESSION = [*KEY, "session"]
#: Events come hours apart here: blocks of five days.
SCANNED = 5 * scans.BLOCK


def query(f):
    QUERIES[f.__name__] = f
    return f


def with_sql(sql: str):
    def add(f):
        SQL[f.__name__] = sql
        return query(f)

    return add


#: Events with their session and place in it.
SESSION_SQL = f"""{E_SQL}, d AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS dt FROM e), s AS (SELECT *, CAST(sum(CASE WHEN dt > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS session FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY us, event_id) AS nth FROM s)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the session that recursive operators restart in: it ends at a long gap alone."""
    return se.with_sessions(stream(spark, sf_dir), KEY, "us", "event_id", GAP)


@with_sql(
    f"""WITH RECURSIVE {SESSION_SQL}, r AS (SELECT user_id, session, nth, event_id, value AS ema FROM n WHERE nth = 1 UNION ALL SELECT n.user_id, n.session, n.nth, n.event_id, r.ema + 0.01::DOUBLE * (n.value - r.ema) FROM r JOIN n ON n.user_id = r.user_id AND n.session = r.session AND n.nth = r.nth + 1)
SELECT event_id, round(ema, 9) AS ema FROM r"""
)
def ema_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.exponential(stream(spark, sf_dir), KEY, "us", "event_id", "value", 0.01, GAP, block=SCANNED).select("event_id", F.round("ema", 9).alias("ema"))


#: The same rules a row at a time: state, and since when value has been over or under.
STEP_SQL = """SELECT *, CASE WHEN us - first >= 2000000 AND above IS NOT NULL AND us - above >= 200000 THEN 1 WHEN us - first >= 2000000 AND below IS NOT NULL AND us - below >= 1000000 THEN 0 ELSE prior END AS state FROM
(SELECT *, CASE WHEN us - first < 2000000 THEN p_above WHEN value > 50 THEN coalesce(p_above, us) END AS above, CASE WHEN us - first < 2000000 THEN p_below WHEN value < 35 THEN coalesce(p_below, us) END AS below FROM ({of}))"""


@with_sql(
    f"""WITH RECURSIVE {SESSION_SQL}, r AS ({STEP_SQL.format(of="SELECT user_id, session, nth, event_id, us, us AS first, value, CAST(NULL AS BIGINT) AS p_above, CAST(NULL AS BIGINT) AS p_below, CAST(NULL AS INTEGER) AS prior FROM n WHERE nth = 1")}
UNION ALL {STEP_SQL.format(of="SELECT n.user_id, n.session, n.nth, n.event_id, n.us, r.first, n.value, r.above AS p_above, r.below AS p_below, r.state AS prior FROM r JOIN n ON n.user_id = r.user_id AND n.session = r.session AND n.nth = r.nth + 1")})
SELECT event_id, state FROM r"""
)
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 moving, 0 still, null calibrating; dwell times and warm-up in microseconds."""
    return scans.dwelling(stream(spark, sf_dir), KEY, "us", "event_id", "value", 50.0, 35.0, 200_000, 1_000_000, 2_000_000, GAP, SCANNED).select("event_id", "state")


@query
def bandpass_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings read as beat windows of 64 samples at 16 Hz."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        y = waves.zero_phase(x, waves.band_pass(4, 0.7, 3.0, RATE))
        s = waves.spectral(y, RATE, 0.7, 3.0)
        bpm, why = rates.by_agreement(y, RATE)
        return {"dominant_hz": s["dominant_hz"], "entropy": s["entropy"], "bpm": bpm, "rejection": why}

    e, made = read(spark, sf_dir, "embeddings"), {"dominant_hz": "double", "entropy": "double", "bpm": "double", "rejection": "string"}
    fit = F.coalesce(F.size("embedding") == 64, F.lit(False))
    odd = e.where(~fit).select("vec_id", *(F.lit("wrong_length" if k == "rejection" else None).cast(t).alias(k) for k, t in made.items()))
    return over_matrix(e.where(fit).select("vec_id", "embedding"), "embedding", made, f).unionByName(odd)


#: Samples that a window of a session holds at most.
WINDOW = 256


@query
def beat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device's session of values, in windows of WINDOW evenly sampled rows; those of under nine have no beats."""
    names = ["n_beats", "crest_phase", "width_50", "width_25", "area", "template_correlation"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column(3):
                x = v.values.field("value").to_numpy(zero_copy_only=False).astype(float)
                x = x - x.mean()
                rows.append(dsp.beat_features(waves.zero_phase(x, waves.band_pass(4, 0.7, 3.0, RATE))[0] if x.std() > 0 else x, RATE))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([r[k] for r in rows], pa.float64()) for k in names)], names=[*SESSION, "part", *names])

    nth = F.row_number().over(se.in_order(SESSION, "us", "event_id"))
    cut = sessions(spark, sf_dir).withColumn("part", F.floor((nth - 1) / WINDOW))
    w = cut.groupBy(*SESSION, "part").agg(F.sort_array(F.collect_list(F.struct("us", "event_id", "value"))).alias("rows"))  # WINDOW rows at most
    long = w.where(F.size("rows") > 8).mapInArrow(run, "user_id long, session long, part long, " + ", ".join(f"{n} double" for n in names))
    short = w.where(F.size("rows") <= 8).select(*SESSION, "part", F.lit(0.0).alias("n_beats"), *[F.lit(None).cast("double").alias(n) for n in names[1:]])
    return long.unionByName(short)


@with_sql(
    f"""WITH {PRED_SQL}, q AS (SELECT o_custkey, truth AS t, guess AS x, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END AS u FROM p WHERE guess IS NOT NULL),
g AS (SELECT o_custkey, count(*) AS n, sum(x) AS x, sum(u) AS u, sum(t) AS t, sum(x * x) AS xx, sum(x * u) AS xu, sum(u * u) AS uu, sum(x * t) AS xt, sum(u * t) AS ut FROM q GROUP BY o_custkey), a AS (SELECT sum(n) AS n, sum(x) AS x, sum(u) AS u, sum(t) AS t, sum(xx) AS xx, sum(xu) AS xu, sum(uu) AS uu, sum(xt) AS xt, sum(ut) AS ut FROM g),
l AS (SELECT o_custkey, CAST(a.n - g.n AS DOUBLE) AS n, (a.x - g.x) / (a.n - g.n) AS mx, (a.u - g.u) / (a.n - g.n) AS mu, (a.t - g.t) / (a.n - g.n) AS mt, (a.xx - g.xx) / (a.n - g.n) AS xx, (a.xu - g.xu) / (a.n - g.n) AS xu, (a.uu - g.uu) / (a.n - g.n) AS uu, (a.xt - g.xt) / (a.n - g.n) AS xt, (a.ut - g.ut) / (a.n - g.n) AS ut FROM g, a),
c AS (SELECT *, sqrt(xx - mx * mx) AS zx, sqrt(uu - mu * mu) AS zu FROM l), s AS (SELECT *, (xu - mx * mu) / (zx * zu) * n AS k, (xt - mx * mt) / zx * n AS rx, (ut - mu * mt) / zu * n AS ru FROM c),
w AS (SELECT *, (rx * (n + 1) - k * ru) / ((n + 1) * (n + 1) - k * k) / zx AS bx, (ru * (n + 1) - k * rx) / ((n + 1) * (n + 1) - k * k) / zu AS bu FROM s)
SELECT o_custkey, n AS n_train, round(mt - bx * mx - bu * mu, 6) AS intercept, round(bx, 6) AS b_guess, round(bu, 6) AS b_is_urgent FROM w"""
)
def ridge_lopo(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).where("guess is not null").withColumn("is_urgent", (F.col("o_orderpriority") == "1-URGENT").cast("double"))
    m = models.ridge_left_out(p, "o_custkey", ["guess", "is_urgent"], "truth")
    return m.select("o_custkey", "n_train", *[r6(c).alias(c) for c in ("intercept", "b_guess", "b_is_urgent")])


@with_sql(
    f"""WITH {PRED_SQL}, g AS (SELECT o_custkey, sum(abs(guess - truth)) AS s, count(*) AS c FROM p WHERE guess IS NOT NULL GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY o_custkey) - 1 AS rank, count(*) OVER () AS n FROM g),
k AS (SELECT draw, CAST('0x' || substr(md5('11/' || CAST(draw AS VARCHAR) || '/' || CAST(rank AS VARCHAR)), 1, 8) AS BIGINT) % n AS pick FROM r, (SELECT unnest(generate_series(1, 200)) AS draw)), m AS (SELECT draw, sum(s) / sum(c) AS m FROM k JOIN r ON pick = rank GROUP BY draw)
SELECT (SELECT round(sum(s) / sum(c), 6) FROM g) AS mean, (SELECT count(*) FROM g) AS groups, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).where("guess is not null").withColumn("err", F.abs(F.col("guess") - F.col("truth")))
    b = models.bootstrap_mean(p, "o_custkey", "err")
    return b.select(r6("mean").alias("mean"), "groups", r6("low").alias("low"), r6("high").alias("high"))


@with_sql(
    f"""WITH {E_SQL}, t AS (SELECT event_id, event_type, us, value, k, CASE event_type WHEN 'error' THEN 'status' WHEN 'click' THEN 'imu' WHEN 'signup' THEN 'noise' ELSE 'ppg' END AS kind FROM e)
SELECT event_id, kind, CASE WHEN kind = 'ppg' THEN us // 1000 END AS timestamp_ms, CASE WHEN kind = 'ppg' THEN CAST(trunc(value * 100) AS BIGINT) END AS red, CASE WHEN kind = 'imu' THEN CAST(trunc(-value) AS BIGINT) END AS y_raw, CASE WHEN kind = 'status' THEN 'warning' END AS status_type, CASE WHEN kind = 'status' THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) END AS level FROM t"""
)
def telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as telemetry lines and parsed back."""
    e = stream(spark, sf_dir)
    n = lambda c: c.cast("long").cast("string")
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("# warning event=e"), n(F.col("k")), F.lit(", level="), n(F.col("value"))))
        .when(F.col("event_type") == "click", F.concat_ws(",", F.lit("imu"), n(F.col("event_id")), n(F.col("us") / 1000), n(F.col("value")), n(-F.col("value")), n(F.col("k"))))
        .when(F.col("event_type") == "signup", F.lit("sample_seq,timestamp_ms,red,ir"))
        .otherwise(F.concat_ws(",", n(F.col("event_id")), n(F.col("us") / 1000), n(F.col("value") * 100), n(F.col("k"))))
    )
    parsed = telemetry.with_kind(e.select("event_id", "event_type", line.alias("line")))
    return parsed.select("event_id", "kind", "ppg.timestamp_ms", F.col("ppg.red").alias("red"), F.col("imu.y_raw").alias("y_raw"), F.col("status.type").alias("status_type"), F.element_at("status.fields", "level").alias("level"))


@with_sql(f"WITH {E_SQL} SELECT event_id, 'ppg' AS kind, event_id AS seq, us // 1000 % 1000000000 AS timestamp_ms, CAST(trunc(value * 100) AS BIGINT) AS a, k AS b FROM e")
def packet_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed as absolute sample packets and decoded again."""
    little = lambda c: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c.cast("long")), 8, "0"), i, 2) for i in (7, 5, 3, 1)]))
    e = stream(spark, sf_dir)
    packet = F.concat(F.unhex(F.lit("81")), little(F.col("event_id")), little(F.expr("us div 1000 % 1000000000")), little(F.col("value") * 100), little(F.col("k")))
    return telemetry.decode_packets(e.select("event_id", packet.alias("packet"))).select("event_id", "kind", "seq", "timestamp_ms", "a", "b")


@with_sql(
    f"""WITH {E_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS nth FROM e)
SELECT user_id, 'ppg' AS kind, nth AS seq, nth * 10 AS timestamp_ms, CAST(trunc(value * 100) AS BIGINT) % 262144 AS a, k % 262144 AS b FROM n"""
)
def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's events as batches of five, two of three of them relative to the one before, and decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packets = []
            for part, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                samples = [(10 * r["nth"], r["a"], r["b"]) for r in rows]
                first = rows[0]["nth"]
                packets.append(telemetry.delta_packet(telemetry.PPG_DELTA, 10 * first - 10, samples) if part % 3 else telemetry.batch_packet(telemetry.PPG_BATCH, first, 10 * first, samples))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packets, pa.binary())], names=["user_id", "part", "packet"])

    nth = F.row_number().over(se.in_order(KEY, "us", "event_id")).cast("long") - 1
    e = stream(spark, sf_dir).select("user_id", nth.alias("nth"), ((F.col("value") * 100).cast("long") % 262144).alias("a"), (F.col("k") % 262144).alias("b"))
    packed = e.groupBy("user_id", F.floor(F.col("nth") / 5).alias("part")).agg(F.sort_array(F.collect_list(F.struct("nth", "a", "b"))).alias("rows"))  # five rows
    sent = packed.select("user_id", "part", "rows").mapInArrow(run, "user_id long, part long, packet binary")
    return telemetry.placed_samples(sent, KEY, "part").select("user_id", "kind", "seq", "timestamp_ms", "a", "b")


@with_sql(
    f"""WITH {SESSION_SQL}, h AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN event_type <> 'error' THEN us END IGNORE NULLS) OVER w AS v_us FROM n WINDOW w AS (PARTITION BY user_id, session ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, CASE WHEN us - v_us = 0 THEN 'current' WHEN us - v_us <= {GAP} THEN 'held' ELSE 'unavailable' END AS mode FROM h)
SELECT event_id, session, mode, CASE WHEN mode <> 'unavailable' THEN v END AS shown FROM m"""
)
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of streaming.live.live_sessions: sessions and the value held within them."""
    s = se.with_sessions(stream(spark, sf_dir), KEY, "us", "event_id", GAP)
    v = F.when(F.col("event_type") != "error", F.col("value"))
    return se.held(s, [*KEY, "session"], "us", "event_id", v, GAP).select("event_id", "session", "mode", "shown")
