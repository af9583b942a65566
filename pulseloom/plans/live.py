"""Queries of the live operators on tables: the same functions as on streams, and what silence leaves behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consensus
from ..operators import series as se
from ..streaming import paired, shadow, silence
from .catalogue import E_SQL, HOUR, KEY, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


#: Events come hours apart: the rules of paired streams in hours.
PAIRED = paired.Rules(width=8 * HOUR // 1000, step=4 * HOUR // 1000, late=HOUR // 1000, reach=6 * HOUR // 1000, longest_gap=4 * HOUR // 1000, completeness=0.8)
_W, _S, _R, _G = (x * 1000 for x in (PAIRED.width, PAIRED.step, PAIRED.reach, PAIRED.longest_gap))


#: Windows of both streams as the CTE j.
_WINDOWS = f"""{E_SQL},
o AS (SELECT user_id, us, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq FROM e WHERE event_type IN ('view', 'click')),
m AS (SELECT user_id, us, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq FROM e WHERE event_type NOT IN ('view', 'click') AND event_id % 97 <> 0),
a AS (SELECT o.*, CASE WHEN o.us - m.us <= {_R} THEN m.us END AS a_us, m.x AS a_x FROM o ASOF LEFT JOIN m ON o.user_id = m.user_id AND o.us >= m.us),
b AS (SELECT a.*, CASE WHEN m.us - a.us <= {_R} THEN m.us END AS b_us, m.x AS b_x FROM a ASOF LEFT JOIN m ON a.user_id = m.user_id AND a.us <= m.us),
r AS (SELECT user_id, us, seq, 'ppg' AS kind, CASE WHEN a_us IS NOT NULL AND b_us IS NOT NULL THEN coalesce(a_x + (b_x - a_x) * (us - a_us) / nullif(b_us - a_us, 0), a_x) END AS x FROM b UNION ALL SELECT user_id, us, seq, 'imu', x FROM m),
w AS (SELECT r.*, unnest(generate_series(CAST((floor((us - {_W}) / {_S}.0) + 1) * {_S} AS BIGINT), CAST(floor(us / {_S}.0) * {_S} AS BIGINT), {_S})) AS start_us FROM r),
d AS (SELECT *, us - lag(us) OVER p AS dt, seq - lag(seq) OVER p AS dseq FROM w WINDOW p AS (PARTITION BY user_id, start_us, kind ORDER BY us, seq)),
g AS (SELECT user_id, start_us, kind, count(*) AS n, quantile_cont(dt, 0.5) AS mid, max(dt) AS widest, min(us) AS first, max(us) AS last, coalesce(bool_or(dseq <> 1 OR dt <= 0), false) AS fault, bool_or(x IS NULL) AS bare, avg(x) AS mean_x FROM d GROUP BY ALL),
k AS (SELECT DISTINCT user_id, start_us FROM g),
j AS (SELECT k.user_id, k.start_us, coalesce(p.n, 0) AS ppg_samples, coalesce(i.n, 0) AS imu_samples,
  CASE WHEN p.mid > 0 THEN least(1.0::DOUBLE, p.n / greatest({_W}::DOUBLE / p.mid, 1.0::DOUBLE)) ELSE 0 END AS ppg_completeness, CASE WHEN i.mid > 0 THEN least(1.0::DOUBLE, i.n / greatest({_W}::DOUBLE / i.mid, 1.0::DOUBLE)) ELSE 0 END AS imu_completeness, p.mean_x,
  concat_ws(';', CASE WHEN coalesce(i.fault, false) THEN 'imu_sequence_fault' END, CASE WHEN coalesce(i.n, 0) < 2 OR i.widest > {_G} THEN 'imu_timestamp_gap' END,
   CASE WHEN CASE WHEN i.mid > 0 THEN least(1.0::DOUBLE, i.n / greatest({_W}::DOUBLE / i.mid, 1.0::DOUBLE)) ELSE 0 END < {PAIRED.completeness} THEN 'incomplete_imu_window' END,
   CASE WHEN CASE WHEN p.mid > 0 THEN least(1.0::DOUBLE, p.n / greatest({_W}::DOUBLE / p.mid, 1.0::DOUBLE)) ELSE 0 END < {PAIRED.completeness} THEN 'incomplete_ppg_window' END,
   CASE WHEN coalesce(p.bare, false) THEN 'insufficient_imu_interpolation_coverage' END,
   CASE WHEN p.mid IS NULL OR i.mid IS NULL OR p.first - k.start_us > p.mid OR k.start_us + {_W} - p.last > p.mid OR i.first - k.start_us > i.mid OR k.start_us + {_W} - i.last > i.mid THEN 'outside_common_sensor_coverage' END,
   CASE WHEN coalesce(p.fault, false) THEN 'ppg_sequence_fault' END, CASE WHEN coalesce(p.n, 0) < 2 OR p.widest > {_G} THEN 'ppg_timestamp_gap' END) AS reasons
  FROM k LEFT JOIN g p ON p.user_id = k.user_id AND p.start_us = k.start_us AND p.kind = 'ppg' LEFT JOIN g i ON i.user_id = k.user_id AND i.start_us = k.start_us AND i.kind = 'imu')"""


@query(
    "paired_windows",
    f"""WITH {_WINDOWS}
SELECT user_id, start_us, ppg_samples, imu_samples, round(ppg_completeness, 6) AS ppg_completeness, round(imu_completeness, 6) AS imu_completeness, reasons, round(mean_x, 6) AS mean_x FROM j""",
)
def paired_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as the optical stream, other events as motion with some rows lost, in checked windows."""
    w = _windows(spark, sf_dir)
    return w.select(F.col("device").alias("user_id"), "start_us", "ppg_samples", "imu_samples", *(F.round(c, 6).alias(c) for c in ("ppg_completeness", "imu_completeness")), "reasons", F.round("mean_x", 6).alias("mean_x"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir)
    nth = F.row_number().over(se.in_order(KEY, "us", "event_id")).cast("long")
    of = lambda rows, **made: rows.select(F.col("user_id").alias("device"), F.timestamp_micros("us").alias("ts"), nth.alias("seq"), *(c.alias(k) for k, c in made.items()))
    optical = of(e.where("event_type in ('view', 'click')"), red=F.col("value"), ir=F.col("value"))
    motion = of(e.where("event_type not in ('view', 'click') and event_id % 97 <> 0"), x=F.col("value"), y=F.col("k").cast("double"), z=F.lit(1.0))
    w = paired.checked_windows(optical, motion, PAIRED)
    mean = F.aggregate(F.filter("samples", lambda s: s["x"].isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, s: F.struct((a["s"] + s["x"]).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"] / F.nullif(a["n"], F.lit(0.0)))
    return w.withColumn("mean_x", mean)


#: Ticks every two hours, and patience to match.
PATIENCE = silence.Patience(beat=2 * HOUR, connection=10 * HOUR, motion=20 * HOUR, analysis=30 * HOUR, hold=90 * HOUR, forget=100 * HOUR)
_HOLD = ", ".join(f"'{x}'" for x in silence.HOLDABLE)


@query(
    "silent_records",
    f"""WITH {E_SQL},
r AS (SELECT user_id, us, CASE event_type WHEN 'view' THEN 'sample' WHEN 'click' THEN 'motion' WHEN 'signup' THEN 'motion' WHEN 'purchase' THEN 'analysis' ELSE 'fault' END AS kind,
  CASE WHEN event_type IN ('click', 'signup') THEN CASE WHEN value > 60 THEN 'moving' WHEN value < 5 THEN 'calibrating' ELSE 'still' END WHEN event_type = 'purchase' THEN CASE WHEN value < 30 THEN 'poor_waveform_quality' ELSE 'accepted' END END AS status,
  CASE WHEN event_type = 'purchase' AND value >= 30 THEN value END AS value FROM e),
n AS (SELECT *, us - lag(us) OVER w AS dt, lead(us) OVER w AS nxt FROM r WINDOW w AS (PARTITION BY user_id ORDER BY us)),
l AS (SELECT *, sum(CASE WHEN dt > {PATIENCE.forget} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS life FROM n),
t AS (SELECT DISTINCT user_id, life, unnest(generate_series((us + {PATIENCE.beat} - 1) // {PATIENCE.beat} * {PATIENCE.beat}, least(coalesce(nxt, {1 << 62}) - 1, us + {PATIENCE.forget}, (SELECT max(us) FROM e)), {PATIENCE.beat})) AS us FROM l),
u AS (SELECT user_id, life, us, kind, status, value, 1 AS turn FROM l UNION ALL SELECT user_id, life, us, 'tick', NULL, NULL, 2 FROM t),
h AS (SELECT user_id, us, kind,
  last_value(CASE WHEN kind <> 'tick' THEN us END IGNORE NULLS) OVER w AS line_us, last_value(CASE WHEN kind = 'motion' THEN us END IGNORE NULLS) OVER w AS motion_us, last_value(CASE WHEN kind = 'motion' THEN status END IGNORE NULLS) OVER w AS motion,
  last_value(CASE WHEN kind = 'analysis' THEN us END IGNORE NULLS) OVER w AS analysis_us, last_value(CASE WHEN kind = 'analysis' THEN status WHEN kind = 'fault' THEN 'invalid_timing' END IGNORE NULLS) OVER w AS analysis,
  last_value(CASE WHEN kind = 'analysis' THEN coalesce(value, -1) WHEN kind = 'fault' THEN -1 END IGNORE NULLS) OVER w AS estimate,
  last_value(CASE WHEN kind = 'analysis' AND value IS NOT NULL THEN us WHEN kind = 'fault' THEN -1 END IGNORE NULLS) OVER w AS good_us, last_value(CASE WHEN kind = 'analysis' AND value IS NOT NULL THEN value WHEN kind = 'fault' THEN -1 END IGNORE NULLS) OVER w AS good
  FROM u WINDOW w AS (PARTITION BY user_id, life ORDER BY us, turn ROWS UNBOUNDED PRECEDING)),
k AS (SELECT user_id, us, line_us, motion_us, motion, analysis_us, analysis, nullif(estimate, -1) AS estimate, nullif(good_us, -1) AS good_us, nullif(good, -1) AS good FROM h WHERE kind = 'tick'),
s AS (SELECT *, CASE WHEN coalesce(us - motion_us > {PATIENCE.motion}, true) THEN 'motion_stale' WHEN motion = 'moving' THEN 'motion_detected' WHEN motion <> 'still' THEN motion
  WHEN estimate IS NOT NULL AND us - line_us > {PATIENCE.connection} THEN 'connection_stale' WHEN estimate IS NOT NULL AND coalesce(us - analysis_us > {PATIENCE.analysis}, true) THEN 'analysis_stale' ELSE coalesce(analysis, 'warming_up') END AS status FROM k),
m AS (SELECT *, CASE WHEN estimate IS NOT NULL AND motion = 'still' AND status NOT IN ('motion_stale', 'motion_detected', 'connection_stale', 'analysis_stale') THEN 'current' WHEN status IN ({_HOLD}) AND good IS NOT NULL AND us - good_us <= {PATIENCE.hold} THEN 'held' ELSE 'unavailable' END AS mode FROM s)
SELECT user_id, us AS tick_us, CASE WHEN us - line_us > {PATIENCE.connection} THEN 'stale' ELSE 'connected' END AS connection, status, mode, CASE mode WHEN 'current' THEN estimate WHEN 'held' THEN good END AS value, CASE WHEN mode <> 'unavailable' THEN us - good_us END AS age_us,
  coalesce(status IN ({_HOLD}) AND mode = 'unavailable' AND us - good_us > {PATIENCE.hold}, false) AS expired FROM m""",
)
def silent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a display of each device shows at every tick, also while the device is silent."""
    e = stream(spark, sf_dir)
    of = F.col("event_type")
    kind = F.when(of == "view", "sample").when(of.isin("click", "signup"), "motion").when(of == "purchase", "analysis").otherwise("fault")
    motion = F.when(F.col("value") > 60, "moving").when(F.col("value") < 5, "calibrating").otherwise("still")
    status = F.when(of.isin("click", "signup"), motion).when(of == "purchase", F.when(F.col("value") < 30, "poor_waveform_quality").otherwise("accepted"))
    rows = e.select(F.col("user_id").alias("device"), "us", kind.alias("kind"), status.alias("status"), F.when((of == "purchase") & (F.col("value") >= 30), F.col("value")).alias("value"))
    until = rows.agg(F.max("us")).first()[0]  # one number
    return silence.records(silence.ticks_of(rows, until or 0, PATIENCE, 10 * 24 * HOUR), PATIENCE).withColumnRenamed("device", "user_id")


_CONFIG = '{"window_seconds": 28800, "window_step_seconds": 14400}'
#: A package as a study would have frozen it.
PACKAGE = shadow.opened(shadow.frozen("logistic_v1", ["mean_x", "ppg_samples"], [48.0, 3.0], [20.0, 1.5], [-0.8, 0.9], 0.25, 0.55, _CONFIG), _CONFIG)
_P = "round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.25::DOUBLE + (mean_x - 48.0::DOUBLE) / 20.0::DOUBLE * -0.8::DOUBLE + (ppg_samples - 3.0::DOUBLE) / 1.5::DOUBLE * 0.9::DOUBLE))), 6)"


@query(
    "shadow_records",
    f"""WITH {_WINDOWS},
v AS (SELECT *, array_to_string(list_filter(string_split(reasons, ';'), lambda x: x NOT IN ('outside_common_sensor_coverage', 'incomplete_ppg_window', 'incomplete_imu_window', 'ppg_timestamp_gap', '')), ';') AS why FROM j),
u AS (SELECT *, CASE WHEN why = '' THEN {_P} END AS p FROM v)
SELECT user_id AS device, round(greatest(start_us + {_W}, 0) / 1e6, 3) AS elapsed_s, start_us / 1000.0::DOUBLE AS window_start_timestamp_ms, (start_us + {_W}) / 1000.0::DOUBLE AS window_end_timestamp_ms, CASE WHEN p >= 0.55 THEN 'unusable' WHEN p < 0.55 THEN 'usable' END AS prediction, p < 0.55 AS usable,
 p AS unusable_probability, 0.55::DOUBLE AS decision_threshold, CASE WHEN why <> '' THEN 'invalid_window' WHEN p >= 0.55 THEN 'unusable' WHEN p < 0.55 THEN 'usable' ELSE 'analysis_error' END AS status,
 CASE WHEN why <> '' THEN why WHEN p IS NOT NULL THEN '{shadow.REASON}' ELSE 'a feature is missing or not finite' END AS reason, ppg_samples AS ppg_sample_count, imu_samples AS imu_sample_count, round(ppg_completeness, 6) AS ppg_completeness, round(imu_completeness, 6) AS imu_completeness,
 '{PACKAGE.name}' AS model_name, '{PACKAGE.sha256}' AS model_sha256, true AS shadow_mode, false AS affects_bp_or_hr FROM u""",
)
def shadow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a frozen classifier says of the paired windows; few events a window, so gaps and edges do not refuse them here."""
    mild = ["outside_common_sensor_coverage", "incomplete_ppg_window", "incomplete_imu_window", "ppg_timestamp_gap", ""]
    why = F.array_join(F.filter(F.split("reasons", ";"), lambda r: ~r.isin(mild)), ";")
    return shadow.shadowed(_windows(spark, sf_dir).withColumn("reasons", why), PACKAGE)


@query(
    "gated_consensus",
    f"""WITH {E_SQL},
w AS (SELECT user_id, us // {96 * HOUR} AS trial, us // {HOUR} AS start_s, us // {HOUR} + 20 AS end_s, 60 + value * (user_id % 5) / 7.3::DOUBLE AS bpm, CASE WHEN event_type = 'error' THEN 'motion_contaminated' WHEN event_type = 'signup' THEN 'poor_contact' WHEN k < 10 THEN 'poor_waveform_quality' ELSE 'accepted' END AS status FROM e),
g AS (SELECT * FROM w WHERE status = 'accepted'),
c AS (SELECT a.user_id, a.trial, a.bpm AS centre, count(*) AS members, coalesce(stddev_pop(b.bpm), 0) AS spread FROM (SELECT DISTINCT user_id, trial, bpm FROM g) a JOIN g b ON a.user_id = b.user_id AND a.trial = b.trial AND b.bpm BETWEEN a.bpm - 5 AND a.bpm + 5 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, trial ORDER BY members DESC, round(spread, 6), centre) AS rn FROM c), win AS (SELECT * FROM n WHERE rn = 1),
i AS (SELECT g.*, abs(g.bpm - win.centre) <= 5 AS inside FROM g JOIN win USING (user_id, trial)), o AS (SELECT * FROM i WHERE NOT inside),
ru AS (SELECT user_id, trial, max(m) AS runner_up FROM (SELECT a.user_id, a.trial, a.bpm, count(*) AS m FROM (SELECT DISTINCT user_id, trial, bpm FROM o) a JOIN o b ON a.user_id = b.user_id AND a.trial = b.trial AND b.bpm BETWEEN a.bpm - 5 AND a.bpm + 5 GROUP BY ALL) GROUP BY ALL),
f AS (SELECT user_id, trial, count(*) FILTER (inside) AS winners, round(median(CASE WHEN inside THEN bpm END), 2) AS mid, coalesce(nullif(regr_slope(CASE WHEN inside THEN bpm END, CASE WHEN inside THEN (start_s + end_s) / 2.0::DOUBLE END), 'NaN'::DOUBLE), 0) AS trend FROM i GROUP BY ALL),
u AS (SELECT *, max(end_s) OVER (PARTITION BY user_id, trial ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM g), v AS (SELECT user_id, trial, sum(greatest(end_s - greatest(start_s, coalesce(upto, start_s)), 0))::BIGINT AS coverage_s FROM u GROUP BY ALL),
t AS (SELECT user_id, trial, count(*) AS windows, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'motion_contaminated') AS moved, count(*) FILTER (status = 'poor_contact') AS loose, count(*) FILTER (status = 'poor_waveform_quality') AS poor FROM w GROUP BY ALL),
j AS (SELECT t.*, coalesce(v.coverage_s, 0) AS coverage_s, coalesce(f.winners, 0) AS winners, coalesce(ru.runner_up, 0) AS runner_up, coalesce(f.trend, 0) AS trend, f.mid FROM t LEFT JOIN v USING (user_id, trial) LEFT JOIN f USING (user_id, trial) LEFT JOIN ru USING (user_id, trial)),
z AS (SELECT *, CASE WHEN accepted < 3 OR coverage_s < 30 THEN CASE WHEN greatest(moved, loose) > 0 THEN CASE WHEN moved >= loose THEN 'motion_contaminated' ELSE 'contact_artifact' END WHEN poor > 0 THEN 'poor_waveform_quality' ELSE 'insufficient_clean_data' END
  WHEN winners >= ceil(0.6::DOUBLE * accepted) AND winners >= 2 * runner_up AND abs(trend) <= 0.15 THEN 'usable' ELSE 'ambiguous_hr' END AS status FROM j)
SELECT user_id, trial, status, CASE WHEN accepted < 3 OR coverage_s < 30 THEN 'too few windows or too little coverage' WHEN NOT (winners >= ceil(0.6::DOUBLE * accepted) AND winners >= 2 * runner_up) THEN 'no cluster is well ahead' WHEN abs(trend) > 0.15 THEN 'the rate changes too quickly' ELSE 'consensus' END AS reason,
 CASE WHEN status = 'usable' THEN mid END AS bpm, windows, accepted, coverage_s, winners, runner_up, round(trend, 6) AS trend FROM z""",
)
def gated_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four days of a device as a trial of windows of twenty hours (seconds here are hours), under the published gates."""
    e = stream(spark, sf_dir)
    of = F.col("event_type")
    status = F.when(of == "error", "motion_contaminated").when(of == "signup", "poor_contact").when(F.col("k") < 10, "poor_waveform_quality").otherwise("accepted")
    start = F.expr(f"us div {HOUR}")
    w = e.select("user_id", F.expr(f"us div {96 * HOUR}").alias("trial"), start.alias("start_s"), (start + 20).alias("end_s"), (60 + F.col("value") * (F.col("user_id") % 5) / 7.3).alias("bpm"), status.alias("status"))
    d = consensus.consensus(w, ["user_id", "trial"])
    return d.select(*(F.round(c, 6).alias(c) if c == "trend" else F.col(c) for c in d.columns))
