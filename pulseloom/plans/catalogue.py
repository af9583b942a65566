"""The query catalogue: each operator on the driver's tables, beside the SQL that it must equal.

events stands for a sensor stream (user_id: device, event_id: sequence, value: signal), orders for cuff
occasions (o_custkey: participant), lineitem for an occasion's segments, labels for a review table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import MAD_SCALE, band, median, micros, middle, r6, ratio, reasons, timing_quality
from ..operators import intervals as iv
from ..operators import orderstats
from ..operators import series as se
from ..operators import studies as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

S = 1_000_000
HOUR = 3600 * S
GAP, WIDTH, STEP = 6 * HOUR, 8 * HOUR, 4 * HOUR
KEY = ["user_id"]
E_SQL = "e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("us"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "flagship_occasions",
    f"""WITH {E_SQL},
g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS dt FROM e),
s AS (SELECT *, sum(CASE WHEN dt > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM g),
w AS (SELECT s.*, unnest(generate_series(CAST((floor((us - {WIDTH}) / {STEP}.0) + 1) * {STEP} AS BIGINT), CAST(floor(us / {STEP}.0) * {STEP} AS BIGINT), {STEP})) AS start_us FROM s),
m AS (SELECT user_id, session, start_us, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS mid, count(*) FILTER (event_type = 'error') AS errors FROM w GROUP BY ALL),
d AS (SELECT user_id, session, start_us, {MAD_SCALE} * quantile_cont(abs(value - mid), 0.5) AS mad FROM w JOIN m USING (user_id, session, start_us) GROUP BY ALL),
a AS (SELECT *, n >= 2 AND errors = 0 AS ok FROM m JOIN d USING (user_id, session, start_us)),
i AS (SELECT *, max(start_us + {WIDTH}) OVER (PARTITION BY user_id ORDER BY start_us, session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM a WHERE ok),
j AS (SELECT *, sum(CASE WHEN upto IS NULL OR start_us > upto THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_us, session) AS island FROM i),
c AS (SELECT user_id, sum(x) AS covered_us FROM (SELECT user_id, island, max(start_us + {WIDTH}) - min(start_us) AS x FROM j GROUP BY ALL) GROUP BY user_id),
o AS (SELECT user_id, count(*) AS n_windows, count(*) FILTER (ok) AS n_accepted, round(quantile_cont(CASE WHEN ok THEN mid END, 0.5), 6) AS median_mid, round(quantile_cont(CASE WHEN ok THEN mad END, 0.75) - quantile_cont(CASE WHEN ok THEN mad END, 0.25), 9) AS iqr_mad FROM a GROUP BY user_id)
SELECT user_id, n_windows, n_accepted, CAST(coalesce(covered_us, 0) AS BIGINT) AS covered_us, median_mid, iqr_mad,
 concat_ws(';', CASE WHEN n_accepted < 3 THEN 'few_windows' END, CASE WHEN coalesce(covered_us, 0) < {3 * WIDTH} THEN 'low_coverage' END) AS rejection
FROM o LEFT JOIN c USING (user_id)""",
)
def flagship_occasions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = se.with_sessions(stream(spark, sf_dir), KEY, "us", "event_id", GAP)
    w = iv.in_windows(s, "us", WIDTH, STEP)
    keys = ["user_id", "session", "start_us"]
    # a window's values are few: one grouping has them sorted, and both medians are read off
    m = w.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("value")).alias("v"), F.count_if(F.col("event_type") == "error").alias("errors")).withColumn("mid", middle(F.col("v")))
    off = F.sort_array(F.transform("v", lambda x: F.abs(x - F.col("mid"))))
    d = m.select(*keys, "n", "errors", "mid", (F.lit(MAD_SCALE) * middle(off)).alias("mad"))
    a = d.withColumns({"ok": (F.col("n") >= 2) & (F.col("errors") == 0), "end_us": F.col("start_us") + WIDTH})
    c = iv.covered(a.where("ok"), KEY)
    ok = lambda x: F.when(F.col("ok"), F.col(x))
    o = a.groupBy("user_id").agg(F.count("*").alias("n_windows"), F.count_if("ok").alias("n_accepted"), r6(median(ok("mid"))).alias("median_mid"), F.round(F.percentile(ok("mad"), F.lit(0.75)) - F.percentile(ok("mad"), F.lit(0.25)), 9).alias("iqr_mad"))
    cov = F.coalesce("covered_us", F.lit(0)).cast("long")
    why = reasons(("few_windows", F.col("n_accepted") < 3), ("low_coverage", cov < 3 * WIDTH))
    return o.join(c, "user_id", "left").select("user_id", "n_windows", "n_accepted", cov.alias("covered_us"), "median_mid", "iqr_mad", why.alias("rejection"))


@query(
    "sampling_stats",
    f"""WITH {E_SQL}, d AS (SELECT user_id, us, us - lag(us) OVER w AS dt, event_id - lag(event_id) OVER w AS dseq FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, count(*) AS n, max(us) - min(us) AS span_us, CAST(sum(CASE WHEN dseq > 1 THEN dseq - 1 ELSE 0 END) AS BIGINT) AS missing, min(dt) AS min_dt, max(dt) AS max_dt,
 round(quantile_cont(dt, 0.5), 6) AS median_dt, round(quantile_cont(dt, 0.95), 6) AS p95_dt, round(quantile_cont(dt, 0.99), 6) AS p99_dt, count(*) FILTER (dt > {GAP}) AS long_gaps, count(*) FILTER (dt <= 0) AS backward FROM d GROUP BY user_id""",
)
def sampling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = se.with_deltas(stream(spark, sf_dir), KEY, "us", "event_id")
    p = lambda q: r6(F.percentile("dt", F.lit(q)))
    return d.groupBy("user_id").agg(
        F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("span_us"), F.sum(F.when(F.col("dseq") > 1, F.col("dseq") - 1).otherwise(0)).alias("missing"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"),
        p(0.5).alias("median_dt"), p(0.95).alias("p95_dt"), p(0.99).alias("p99_dt"), F.count_if(F.col("dt") > GAP).alias("long_gaps"), F.count_if(F.col("dt") <= 0).alias("backward"),
    )


@query(
    "gap_events",
    f"""WITH {E_SQL}, d AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS dt FROM e)
SELECT user_id, event_id AS after_id, us - dt AS before_us, us AS after_us, dt AS span_us, us - dt // 2 AS mid_us FROM d WHERE dt > {GAP}""",
)
def gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.gap_events(stream(spark, sf_dir), KEY, "us", "event_id", GAP)


@query(
    "session_islands",
    f"""WITH {E_SQL}, d AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS dt FROM e),
s AS (SELECT *, CAST(sum(CASE WHEN dt > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS session FROM d)
SELECT user_id, session, min(us) AS start_us, max(us) AS end_us, count(*) AS n_rows FROM s GROUP BY ALL""",
)
def session_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = se.with_sessions(stream(spark, sf_dir), KEY, "us", "event_id", GAP)
    return s.groupBy("user_id", "session").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n_rows"))


@query(
    "timing_quality",
    f"""WITH {E_SQL}, d AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS dt FROM e),
c AS (SELECT user_id, count(*) FILTER (dt <= 0) AS backward, count(*) FILTER (dt > {GAP}) AS small, count(*) FILTER (dt > {2 * GAP}) AS large, coalesce(max(dt), 0) AS longest FROM d GROUP BY user_id)
SELECT user_id, small, large, longest, CASE WHEN backward > 0 OR large > 5 OR longest > {8 * GAP} THEN 'reject' WHEN small = 0 AND longest <= {GAP} THEN 'good' WHEN large = 0 AND longest <= {2 * GAP} THEN 'usable' ELSE 'borderline' END AS quality FROM c""",
)
def timing_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = se.with_deltas(stream(spark, sf_dir), KEY, "us", "event_id")
    c = d.groupBy("user_id").agg(F.count_if(F.col("dt") <= 0).alias("backward"), F.count_if(F.col("dt") > GAP).alias("small"), F.count_if(F.col("dt") > 2 * GAP).alias("large"), F.coalesce(F.max("dt"), F.lit(0)).alias("longest"))
    q = timing_quality(F.lit(0), F.col("backward"), F.col("small"), F.col("large"), F.col("longest"), GAP, 2 * GAP, 8 * GAP)
    return c.select("user_id", "small", "large", "longest", q.alias("quality"))


@query(
    "per_bucket_median_steps",
    f"""WITH {E_SQL}, b AS (SELECT user_id, us // {24 * HOUR} AS day, quantile_cont(value, 0.5) AS mid FROM e GROUP BY ALL)
SELECT user_id, day, round(mid, 6) AS mid, round(abs(mid - lag(mid) OVER (PARTITION BY user_id ORDER BY day)), 6) AS step FROM b""",
)
def per_bucket_median_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stream(spark, sf_dir).groupBy("user_id", F.expr(f"us div {24 * HOUR}").alias("day")).agg(median("value").alias("mid"))
    return b.select("user_id", "day", r6("mid").alias("mid"), r6(F.abs(F.col("mid") - F.lag("mid").over(se.in_order(KEY, "day")))).alias("step"))


@query(
    "robust_mad_threshold",
    f"""WITH {E_SQL}, m AS (SELECT user_id, quantile_cont(value, 0.5) AS mid FROM e GROUP BY user_id)
SELECT user_id, round(any_value(mid), 6) AS mid, round({MAD_SCALE} * quantile_cont(abs(value - mid), 0.5), 9) AS mad, round(any_value(mid) + 6 * {MAD_SCALE} * quantile_cont(abs(value - mid), 0.5), 9) AS threshold FROM e JOIN m USING (user_id) GROUP BY user_id""",
)
def robust_mad_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderstats.robust_thresholds(stream(spark, sf_dir), KEY, "value").select("user_id", r6("mid").alias("mid"), *[F.round(c, 9).alias(c) for c in ("mad", "threshold")])


def _frame(before: int, after: int) -> str:
    return f"(PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"


@query("rolling_rms", f"WITH {E_SQL} SELECT event_id, round(sqrt(avg(value * value) OVER {_frame(99, 0)}), 6) AS rms FROM e")
def rolling_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.rolling(stream(spark, sf_dir), KEY, "us", "event_id", 99, 0, sq=F.avg(F.col("value") * F.col("value"))).select("event_id", r6(F.sqrt("sq")).alias("rms"))


@query("rolling_mean_centred", f"WITH {E_SQL} SELECT event_id, round(value - avg(value) OVER {_frame(5, 4)}, 6) AS residual FROM e")
def rolling_mean_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.rolling(stream(spark, sf_dir), KEY, "us", "event_id", 5, 4, m=F.avg("value")).select("event_id", r6(F.col("value") - F.col("m")).alias("residual"))


@query("rolling_median_centred", f"WITH {E_SQL} SELECT event_id, round(quantile_cont(value, 0.5) OVER {_frame(5, 5)}, 6) AS mid FROM e")
def rolling_median_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderstats.rolling_median(stream(spark, sf_dir), KEY, "us", "event_id", "value", 5, 5, block=10 * 24 * HOUR).select("event_id", r6("mid").alias("mid"))


@query("rolling_median_wide", f"WITH {E_SQL} SELECT event_id, round(value - quantile_cont(value, 0.5) OVER {_frame(500, 500)}, 6) AS residual FROM e")
def rolling_median_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each value without the median of the thousand rows around it."""
    e = stream(spark, sf_dir)
    mid = orderstats.rolling_median(e, KEY, "us", "event_id", "value", 500, 500, block=10 * 24 * HOUR).select("event_id", "mid")
    return e.select("event_id", "value").join(mid, "event_id").select("event_id", r6(F.col("value") - F.col("mid")).alias("residual"))


#: Local maxima over a quarter of the standard deviation above the mean; one within 12 hours of the last takes its place if it is higher.
@query(
    "spaced_tops",
    f"""WITH RECURSIVE {E_SQL}, d AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT user_id, avg(value) + 0.25 * stddev_pop(value) AS least FROM e GROUP BY user_id),
c AS (SELECT d.user_id, d.us, d.event_id, d.value, row_number() OVER (PARTITION BY d.user_id ORDER BY d.us, d.event_id) AS nth FROM d JOIN g USING (user_id) WHERE value > round(least, 9) AND value >= a AND value > b),
r AS (SELECT user_id, nth, event_id, us AS last_us, value AS top, 1 AS found, true AS taken FROM c WHERE nth = 1
UNION ALL SELECT c.user_id, c.nth, CASE WHEN c.us - r.last_us >= {12 * HOUR} OR c.value > r.top THEN c.event_id ELSE r.event_id END, CASE WHEN c.us - r.last_us >= {12 * HOUR} OR c.value > r.top THEN c.us ELSE r.last_us END,
  CASE WHEN c.us - r.last_us >= {12 * HOUR} OR c.value > r.top THEN c.value ELSE r.top END, r.found + CASE WHEN c.us - r.last_us >= {12 * HOUR} THEN 1 ELSE 0 END, c.us - r.last_us >= {12 * HOUR} OR c.value > r.top FROM r JOIN c ON c.user_id = r.user_id AND c.nth = r.nth + 1)
SELECT user_id, found AS nth, arg_max(event_id, nth) AS event_id, round(arg_max(top, nth), 6) AS height FROM r GROUP BY user_id, found""",
)
def spaced_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir)
    least = e.groupBy("user_id").agg(F.round(F.avg("value") + 0.25 * F.stddev_pop("value"), 9).alias("least"))
    tops = se.spaced_tops(e.join(least, "user_id"), KEY, "us", "event_id", "value", F.col("least"), 12 * HOUR)
    return tops.select("user_id", "nth", "event_id", r6("value").alias("height"))


@query("mask_dilation", f"WITH {E_SQL} SELECT event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER {_frame(2, 2)} = 1 AS masked FROM e")
def mask_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.dilated(stream(spark, sf_dir), KEY, "us", "event_id", F.col("event_type") == "error", 2, "masked").select("event_id", "masked")


@query(
    "intensity_bands",
    f"""WITH {E_SQL}, b AS (SELECT user_id, CASE WHEN value IS NULL OR isnan(value) OR value < 0 THEN 'unknown' WHEN value < 10 THEN 'stationary' WHEN value < 40 THEN 'mild' WHEN value < 80 THEN 'moderate' ELSE 'severe' END AS band FROM e)
SELECT user_id, band, count(*) AS n FROM b GROUP BY ALL""",
)
def intensity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = band(F.col("value"), [10, 40, 80], ["stationary", "mild", "moderate", "severe"])
    return stream(spark, sf_dir).groupBy("user_id", b.alias("band")).agg(F.count("*").alias("n"))


@query(
    "sliding_windows",
    f"""WITH {E_SQL}, w AS (SELECT e.*, unnest(generate_series(CAST((floor((us - {WIDTH}) / {STEP}.0) + 1) * {STEP} AS BIGINT), CAST(floor(us / {STEP}.0) * {STEP} AS BIGINT), {STEP})) AS start_us FROM e)
SELECT user_id, start_us, count(*) AS n, round(avg(value), 6) AS mean, max(value) - min(value) AS span FROM w GROUP BY ALL""",
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = iv.in_windows(stream(spark, sf_dir), "us", WIDTH, STEP)
    return w.groupBy("user_id", "start_us").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), (F.max("value") - F.min("value")).alias("span"))


@query("trailing_slice", f"WITH {E_SQL}, l AS (SELECT user_id, max(us) AS last_us FROM e GROUP BY user_id) SELECT event_id, user_id, us, last_us - us AS age_us FROM e JOIN l USING (user_id) WHERE us > last_us - {48 * HOUR}")
def trailing_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max("us").over(Window.partitionBy("user_id"))
    return stream(spark, sf_dir).withColumn("last_us", last).where(F.col("us") > F.col("last_us") - 48 * HOUR).select("event_id", "user_id", "us", (F.col("last_us") - F.col("us")).alias("age_us"))


@query(
    "asof_status",
    f"""WITH {E_SQL}, s AS (SELECT user_id, us, k AS level FROM e WHERE event_type = 'signup')
SELECT p.event_id, p.user_id, s.level AS asof_level, p.us - s.us AS age_us FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.us >= s.us""",
)
def asof_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir)
    updates = e.where("event_type = 'signup'").select("user_id", "us", "event_id", F.col("k").alias("level"), F.col("us").alias("since"))
    out = iv.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "us"), updates, KEY, "us", "event_id", ["level", "since"])
    return out.select("event_id", "user_id", "asof_level", (F.col("us") - F.col("asof_since")).alias("age_us"))


@query(
    "asof_expiring_runs",
    f"""WITH {E_SQL}, u AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nxt FROM e),
v AS (SELECT user_id, us AS start_us, least(coalesce(nxt, {2**62}), us + {GAP}) AS end_us FROM u WHERE event_type IN ('view', 'click')),
i AS (SELECT *, max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM v),
j AS (SELECT *, sum(CASE WHEN upto IS NULL OR start_us > upto THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_us, end_us) AS island FROM i)
SELECT user_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_parts FROM j GROUP BY user_id, island""",
)
def asof_expiring_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = iv.as_intervals(stream(spark, sf_dir), KEY, "us", "event_id", GAP).where(F.col("event_type").isin("view", "click"))
    return iv.merged(held, KEY).select("user_id", "start_us", "end_us", "n_parts")


@query(
    "interpolate_join",
    f"""WITH {E_SQL}, p AS (SELECT *, CASE WHEN event_type = 'click' THEN value END AS v, CASE WHEN event_type = 'click' THEN us END AS t FROM e),
q AS (SELECT event_id, us, last_value(v IGNORE NULLS) OVER b AS v0, last_value(t IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(t IGNORE NULLS) OVER a AS t1 FROM p
 WINDOW b AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN t0 = t1 THEN v0 WHEN t1 > t0 THEN v0 + (v1 - v0) * (us - t0) / (t1 - t0) END, 6) AS filled FROM q""",
)
def interpolate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_type") == "click", F.col("value"))
    return se.interpolated(stream(spark, sf_dir), KEY, "us", "event_id", v).select("event_id", r6("filled").alias("filled"))


@query(
    "interval_union_coverage",
    f"""WITH {E_SQL}, v AS (SELECT user_id, us AS start_us, us + (k + 1) * {600 * S} AS end_us FROM e),
i AS (SELECT *, max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM v),
j AS (SELECT *, sum(CASE WHEN upto IS NULL OR start_us > upto THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_us, end_us) AS island FROM i),
m AS (SELECT user_id, island, max(end_us) - min(start_us) AS x FROM j GROUP BY ALL)
SELECT user_id, CAST(sum(x) AS BIGINT) AS covered_us, count(*) AS n_islands FROM m GROUP BY user_id""",
)
def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.covered(stream(spark, sf_dir).select("user_id", F.col("us").alias("start_us"), (F.col("us") + (F.col("k") + 1) * 600 * S).alias("end_us")), KEY)


@query(
    "exclusive_time_partition",
    f"""WITH {E_SQL}, v AS (SELECT user_id, event_id, us AS start_us, us + {GAP} AS end_us, (us + us + {GAP}) // 2 AS mid FROM e),
n AS (SELECT *, lag(mid) OVER w AS l, lead(mid) OVER w AS r FROM v WINDOW w AS (PARTITION BY user_id ORDER BY start_us, end_us))
SELECT event_id, greatest(start_us, coalesce((l + mid) // 2, start_us)) AS own_start_us, least(end_us, coalesce((mid + r) // 2, end_us)) AS own_end_us FROM n""",
)
def exclusive_time_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stream(spark, sf_dir).select("user_id", "event_id", F.col("us").alias("start_us"), (F.col("us") + GAP).alias("end_us"))
    return iv.exclusive(v, KEY).select("event_id", "own_start_us", "own_end_us")


@query(
    "longest_bout",
    f"""WITH {E_SQL}, f AS (SELECT *, value >= 50 AS hot, lag(value >= 50) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM e),
r AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM f),
b AS (SELECT user_id, run, max(us) - min(us) AS bout_us, count(*) AS n FROM r WHERE hot GROUP BY ALL)
SELECT user_id, count(*) AS n_bouts, max(bout_us) AS longest_us, CAST(sum(bout_us) AS BIGINT) AS total_us, max(n) AS most_rows FROM b GROUP BY user_id""",
)
def longest_bout(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = se.islands(stream(spark, sf_dir), KEY, "us", "event_id", F.col("value") >= 50)
    d = F.col("end_us") - F.col("start_us")
    return b.groupBy("user_id").agg(F.count("*").alias("n_bouts"), F.max(d).alias("longest_us"), F.sum(d).alias("total_us"), F.max("n_rows").alias("most_rows"))


@query(
    "hold_last_valid",
    f"""WITH {E_SQL}, h AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN event_type <> 'error' THEN us END IGNORE NULLS) OVER w AS t FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, us - t AS age_us, CASE WHEN us = t THEN 'current' WHEN us - t <= {GAP} THEN 'held' ELSE 'unavailable' END AS mode, CASE WHEN us - t <= {GAP} THEN v END AS shown FROM h""",
)
def hold_last_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_type") != "error", F.col("value"))
    return se.held(stream(spark, sf_dir), KEY, "us", "event_id", v, GAP).select("event_id", "age_us", "mode", "shown")


@query(
    "positional_gap_pairs",
    f"""WITH {E_SQL}, a AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS nth FROM e WHERE event_type = 'view'), b AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS nth FROM e WHERE event_type = 'click')
SELECT a.user_id, a.nth, b.us - a.us AS offset_us FROM a JOIN b ON a.user_id = b.user_id AND a.nth = b.nth""",
)
def positional_gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir)
    nth = F.row_number().over(se.in_order(KEY, "us", "event_id")).cast("long")
    side = lambda t, c: e.where(F.col("event_type") == t).select("user_id", nth.alias("nth"), F.col("us").alias(c))
    return side("view", "__a").join(side("click", "__b"), ["user_id", "nth"]).select("user_id", "nth", (F.col("__b") - F.col("__a")).alias("offset_us"))


@query("json_status_fields", f"WITH {E_SQL} SELECT event_type, k, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY ALL")
def json_status_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).groupBy("event_type", "k").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(
    "line_parse_classify",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN starts_with(line, '#') THEN 'status' WHEN regexp_matches(line, '^[0-9]+(,[0-9]+){3}$') THEN 'sample' WHEN contains(line, ',') THEN 'prose' ELSE 'other' END AS kind, length(line) AS n FROM l)
SELECT kind, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_chars, count(DISTINCT doc_id) AS n_docs FROM c GROUP BY kind""",
)
def line_parse_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    kind = F.when(F.trim("line") == "", "blank").when(F.col("line").startswith("#"), "status").when(F.col("line").rlike("^[0-9]+(,[0-9]+){3}$"), "sample").when(F.col("line").contains(","), "prose").otherwise("other")
    return lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.countDistinct("doc_id").alias("n_docs"))


@query("path_identity", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/:?#]+)', 1) AS host, len(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) - 1 AS depth FROM pages")
def path_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"), (F.size(F.split(rest, "/", -1)) - 1).cast("long").alias("depth"))


@query("label_left_join_report", "SELECT d.source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, count(*) - count(l.doc_id) AS n_unlabelled, count(*) FILTER (l.quality = 1) AS n_good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def label_left_join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").withColumn("__l", F.lit(1)), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("__l").alias("n_labelled"), (F.count("*") - F.count("__l")).alias("n_unlabelled"), F.count_if(F.col("quality") == 1).alias("n_good"))


@query(
    "review_key_set_equality",
    """SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_documents, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_labels,
 (SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents)) AS in_both""",
)
def review_key_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    both = d.unionByName(read(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("doc_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_documents"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_labels"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("in_both"))


@query(
    "semi_anti_filters",
    """SELECT c_mktsegment, count(*) FILTER (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')) AS with_finished, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)) AS without_orders FROM customer c GROUP BY c_mktsegment""",
)
def semi_anti_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), read(spark, sf_dir, "orders")
    key = o["o_custkey"] == c["c_custkey"]
    some = c.join(o.where("o_orderstatus = 'F'"), key, "left_semi").select("c_mktsegment", F.lit(1).alias("a"), F.lit(0).alias("b"))
    none = c.join(o, key, "left_anti").select("c_mktsegment", F.lit(0).alias("a"), F.lit(1).alias("b"))
    every = c.select("c_mktsegment", F.lit(0).alias("a"), F.lit(0).alias("b"))
    return some.unionByName(none).unionByName(every).groupBy("c_mktsegment").agg(F.sum("a").alias("with_finished"), F.sum("b").alias("without_orders"))


ORDERED = ("o_orderdate", "o_orderkey")
O_WIN = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query(
    "calibration_baseline_examples",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderdate, o_orderkey) AS rn FROM orders),
b AS (SELECT *, max(CASE WHEN rn = 1 THEN o_totalprice END) OVER (PARTITION BY o_custkey) AS base FROM r)
SELECT o_orderkey, base AS baseline_o_totalprice, o_totalprice - base AS delta_o_totalprice FROM b WHERE rn > 1""",
)
def calibration_baseline_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = st.calibrated(read(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderpriority") == "1-URGENT", *ORDERED)
    return st.examples(c, ["o_custkey"], ["o_totalprice"]).select("o_orderkey", "baseline_o_totalprice", "delta_o_totalprice")


@query(
    "chronological_split",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER ({O_WIN}) AS position, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, CAST(position AS INTEGER) AS position, CASE WHEN position > n - greatest(5, ceil(0.3 * n)) THEN 'locked' ELSE 'development' END AS split FROM r""",
)
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.chronological(read(spark, sf_dir, "orders"), ["o_custkey"], *ORDERED).select("o_orderkey", "position", "split")


@query(
    "forward_folds",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER ({O_WIN}) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n // 4 = 0 OR pos < n - 3 * (n // 4) THEN 0 ELSE (pos - (n - 3 * (n // 4))) // (n // 4) + 1 END AS fold FROM r""",
)
def forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.forward_folds(read(spark, sf_dir, "orders"), ["o_custkey"], *ORDERED).select("o_orderkey", "fold")


@query(
    "leave_one_group_out_means",
    """WITH g AS (SELECT c_nationkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)
SELECT c_nationkey, n, round(CAST((SELECT sum(s) FROM g) - s AS DOUBLE) / ((SELECT sum(n) FROM g) - n), 6) AS mean_of_others FROM g""",
)
def leave_one_group_out_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    d = o.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return st.leave_one_out_mean(d, "c_nationkey", "p").select("c_nationkey", "n", r6("mean_of_others").alias("mean_of_others"))


@query(
    "occasion_median_iqr",
    """SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS n_accepted, round(quantile_cont(l_quantity, 0.5) FILTER (l_returnflag <> 'R'), 6) AS median_quantity,
 round(quantile_cont(l_quantity, 0.75) FILTER (l_returnflag <> 'R') - quantile_cont(l_quantity, 0.25) FILTER (l_returnflag <> 'R'), 6) AS iqr_quantity FROM lineitem GROUP BY l_orderkey""",
)
def occasion_median_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    q = F.percentile(ok, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("n_accepted"), q.alias("q"))
    return a.select("l_orderkey", "n", "n_accepted", r6(F.get("q", F.lit(1))).alias("median_quantity"), r6(F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr_quantity"))


@query(
    "reason_histogram",
    """WITH r AS (SELECT concat_ws(';', CASE WHEN l_discount > 0.08 THEN 'high_discount' END, CASE WHEN l_quantity < 5 THEN 'low_quantity' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS rs FROM lineitem)
SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN rs = '' THEN 'accepted' ELSE rs END, ';')) AS reason FROM r) GROUP BY reason""",
)
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rs = reasons(("high_discount", F.col("l_discount") > 0.08), ("low_quantity", F.col("l_quantity") < 5), ("returned", F.col("l_returnflag") == "R"))
    r = read(spark, sf_dir, "lineitem").select(F.explode(F.split(F.when(rs == "", "accepted").otherwise(rs), ";")).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n"))


PRED_SQL = f"p AS (SELECT o_custkey, o_orderpriority, o_totalprice / 1000 AS truth, lag(o_totalprice) OVER ({O_WIN}) / 1000 AS guess FROM orders)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = F.lag("o_totalprice").over(se.in_order(["o_custkey"], *ORDERED))
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", (F.col("o_totalprice") / 1000).alias("truth"), (prior / 1000).alias("guess"))


@query(
    "regression_metrics",
    f"""WITH {PRED_SQL} SELECT o_orderpriority, count(guess - truth) AS n, round(avg(abs(guess - truth)), 6) AS mae, round(sqrt(avg((guess - truth) * (guess - truth))), 6) AS rmse, round(avg(guess - truth), 6) AS bias, round(stddev_samp(guess - truth), 6) AS std, round(corr(truth, guess), 6) AS correlation FROM p WHERE guess IS NOT NULL GROUP BY o_orderpriority""",
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = st.error_columns(F.col("truth"), F.col("guess"))
    return predictions(spark, sf_dir).where("guess is not null").groupBy("o_orderpriority").agg(*[(c if k == "n" else r6(c)).alias(k) for k, c in m.items()])


@query(
    "balanced_metrics",
    f"""WITH {PRED_SQL}, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY o_custkey) AS w FROM p WHERE guess IS NOT NULL)
SELECT count(*) AS n, count(DISTINCT o_custkey) AS participants, round(sum(w * abs(guess - truth)) / count(DISTINCT o_custkey), 6) AS mae, round(sqrt(sum(w * (guess - truth) * (guess - truth)) / count(DISTINCT o_custkey)), 6) AS rmse, round(sum(w * (guess - truth)) / count(DISTINCT o_custkey), 6) AS bias FROM w""",
)
def balanced_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("guess") - F.col("truth")
    per = predictions(spark, sf_dir).where("guess is not null").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("a"), F.avg(e * e).alias("s"), F.avg(e).alias("b"))
    return per.agg(F.sum("n").alias("n"), F.count("*").alias("participants"), r6(F.avg("a")).alias("mae"), r6(F.sqrt(F.avg("s"))).alias("rmse"), r6(F.avg("b")).alias("bias"))


@query(
    "grouping_levels",
    """SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderpriority) AS INTEGER) AS is_total, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))""",
)
def grouping_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    sets = o.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderstatus"), F.col("o_orderpriority")]], "o_orderstatus", "o_orderpriority")
    return sets.agg(F.grouping("o_orderpriority").cast("int").alias("is_total"), F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


@query(
    "best_model_vs_baseline",
    f"""WITH p AS (SELECT o_orderpriority, o_totalprice / 1000 AS truth, lag(o_totalprice) OVER ({O_WIN}) / 1000 AS last_value, first_value(o_totalprice) OVER ({O_WIN}) / 1000 AS first_one, 150.0 AS fixed FROM orders),
m AS (SELECT o_orderpriority, round(avg(abs(last_value - truth)), 6) AS last_mae, round(avg(abs(first_one - truth)), 6) AS first_mae, round(avg(abs(fixed - truth)), 6) AS fixed_mae FROM p WHERE last_value IS NOT NULL GROUP BY o_orderpriority)
SELECT o_orderpriority, last_mae, first_mae, fixed_mae, CASE WHEN first_mae <= last_mae AND first_mae <= fixed_mae THEN 'first' WHEN fixed_mae <= last_mae THEN 'fixed' ELSE 'last' END AS best FROM m""",
)
def best_model_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = se.in_order(["o_custkey"], *ORDERED)
    p = read(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1000).alias("t"), (F.lag("o_totalprice").over(w) / 1000).alias("l"), (F.first("o_totalprice").over(w) / 1000).alias("f"))
    mae = lambda g: r6(F.avg(F.abs(g - F.col("t"))))
    m = p.where("l is not null").groupBy("o_orderpriority").agg(mae(F.col("l")).alias("last_mae"), mae(F.col("f")).alias("first_mae"), mae(F.lit(150.0)).alias("fixed_mae"))
    best = F.when((F.col("first_mae") <= F.col("last_mae")) & (F.col("first_mae") <= F.col("fixed_mae")), "first").when(F.col("fixed_mae") <= F.col("last_mae"), "fixed").otherwise("last")
    return m.withColumn("best", best)


@query(
    "confusion_metrics",
    """SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn,
 round(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall, round(count(*) FILTER (quality = 0 AND toxic = 0) / nullif(count(*) FILTER (quality = 0), 0), 6) AS specificity FROM labels""",
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = st.confusion(F.col("quality"), F.col("toxic"))
    return read(spark, sf_dir, "labels").agg(*[c[k].alias(k) for k in ("tp", "fn", "fp", "tn")], *[r6(c[k]).alias(k) for k in ("recall", "specificity")])


@query(
    "roc_auc",
    """WITH s AS (SELECT quality, n_chars AS score FROM labels JOIN documents USING (doc_id)), r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, round((sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc FROM r""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")), "doc_id")
    return st.roc_auc(s, "quality", "score").withColumn("auc", r6("auc"))


@query(
    "stratified_metrics",
    """WITH b AS (SELECT unnest(['short', 'medium', 'long', 'huge']) AS band), s AS (SELECT quality, toxic, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' WHEN n_chars < 500000 THEN 'long' ELSE 'huge' END AS band FROM labels JOIN documents USING (doc_id))
SELECT band, count(quality) AS n, round(avg(CASE WHEN quality IS NOT NULL THEN CASE WHEN quality <> toxic THEN 1.0 ELSE 0.0 END END), 6) AS agreement FROM b LEFT JOIN s USING (band) GROUP BY band""",
)
def stratified_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("band", band(F.col("n_chars").cast("double"), [500, 5000, 500000], ["short", "medium", "long", "huge"]))
    n = s.groupBy("band").agg(F.count("quality").alias("n"), F.avg((F.col("quality") != F.col("toxic")).cast("double")).alias("a"))
    bands = spark.range(1).select(F.explode(F.array(*map(F.lit, ["short", "medium", "long", "huge"]))).alias("band"))
    return bands.join(n, "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("n"), r6("a").alias("agreement"))


@query(
    "audit_summary",
    """SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS participants, min(c_acctbal) AS least, max(c_acctbal) AS most, round(quantile_cont(c_acctbal, 0.5), 6) AS mid FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""",
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    d = r.join(n, r["r_regionkey"] == n["n_regionkey"]).join(c, c["c_nationkey"] == n["n_nationkey"], "left")
    return d.groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("nations"), F.count("c_custkey").alias("participants"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"), r6(median("c_acctbal")).alias("mid"))


@query(
    "conformal_half_width",
    f"""WITH {PRED_SQL}, g AS (SELECT o_orderpriority, o_custkey, max(abs(guess - truth)) AS worst FROM p WHERE guess IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY worst, o_custkey) AS rk, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM g)
SELECT o_orderpriority, any_value(n) AS n_groups, round(max(CASE WHEN rk = ceil((n + 1) * 0.9) THEN worst END), 6) AS half_width FROM r GROUP BY o_orderpriority""",
)
def conformal_half_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = predictions(spark, sf_dir).where("guess is not null").groupBy("o_orderpriority", "o_custkey").agg(F.max(F.abs(F.col("guess") - F.col("truth"))).alias("worst"))
    w = Window.partitionBy("o_orderpriority")
    r = g.withColumns({"rk": F.row_number().over(w.orderBy("worst", "o_custkey")), "n": F.count(F.lit(1)).over(w)})
    return r.groupBy("o_orderpriority").agg(F.first("n").alias("n_groups"), r6(F.max(F.when(F.col("rk") == F.ceil((F.col("n") + 1) * F.lit(0.9)), F.col("worst")))).alias("half_width"))


@query(
    "error_coverage_curve",
    f"""WITH {PRED_SQL}, c AS (SELECT abs(guess - truth) AS err, abs(guess - 150) AS width FROM p WHERE guess IS NOT NULL)
SELECT lim, count(*) FILTER (width <= lim) AS n, round(count(*) FILTER (width <= lim) / count(*), 6) AS coverage, round(avg(err) FILTER (width <= lim), 6) AS mae FROM c, (SELECT unnest([25, 50, 100, 200]) AS lim) GROUP BY lim""",
)
def error_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = predictions(spark, sf_dir).where("guess is not null").select(F.abs(F.col("guess") - F.col("truth")).alias("err"), F.abs(F.col("guess") - 150).alias("width"), F.explode(F.array(*map(F.lit, [25, 50, 100, 200]))).alias("lim"))
    near = F.col("width") <= F.col("lim")
    return c.groupBy("lim").agg(F.count_if(near).alias("n"), r6(ratio(F.count_if(near), F.count("*"))).alias("coverage"), r6(F.avg(F.when(near, F.col("err")))).alias("mae"))


@query("trend_slope", f"WITH {E_SQL} SELECT user_id, count(*) AS n, round(regr_slope(value, (us - 1700000000000000) / {float(HOUR)}), 6) AS slope FROM e GROUP BY user_id")
def trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), r6(F.regr_slope("value", (F.col("us") - 1700000000000000) / F.lit(float(HOUR)))).alias("slope"))


@query(
    "lag_cross_correlation",
    f"""WITH {E_SQL}, p AS (SELECT user_id, value AS x, k, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e)
SELECT l.lag, count(*) AS n, round(corr(a.x, b.k), 6) AS r FROM (SELECT unnest([0, 1, 2, 3]) AS lag) l JOIN p a ON true JOIN p b ON a.user_id = b.user_id AND b.i = a.i + l.lag GROUP BY l.lag""",
)
def lag_cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = se.in_order(KEY, "us", "event_id")
    d = stream(spark, sf_dir).select("value", F.array(*[F.struct(F.lit(i).alias("lag"), F.lead("k", i).over(w).alias("y")) for i in range(4)]).alias("p"))
    d = d.select("value", F.inline("p")).where("y is not null")
    return d.groupBy("lag").agg(F.count("*").alias("n"), r6(F.corr("value", F.col("y").cast("double"))).alias("r"))


@query(
    "template_correlation",
    """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), t AS (SELECT label, i, quantile_cont(x, 0.5) AS m FROM v GROUP BY ALL)
SELECT vec_id, round(corr(x, m), 6) AS r FROM v JOIN t USING (label, i) GROUP BY vec_id""",
)
def template_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    t = v.groupBy("label", "i").agg(median("x").alias("m"))
    return v.join(t, ["label", "i"]).groupBy("vec_id").agg(r6(F.corr("x", "m")).alias("r"))


@query(
    "threshold_search",
    f"""WITH {E_SQL}, c AS (SELECT t, event_type, avg(CASE WHEN value <= t THEN 1.0 ELSE 0.0 END) AS below FROM e, generate_series(1, 200) g(t) GROUP BY ALL)
SELECT event_type, min(t) AS threshold FROM c WHERE below >= 0.95 GROUP BY event_type""",
)
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least whole limit that holds enough of the values: counts by value first, limits after."""
    n = stream(spark, sf_dir).groupBy("event_type", F.greatest(F.ceil("value"), F.lit(1)).cast("long").alias("t")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("event_type"))
    upto = F.sum("n").over(Window.partitionBy("event_type").orderBy("t"))
    return n.withColumns({"upto": upto, "total": total}).where((F.col("upto") >= 0.95 * F.col("total")) & (F.col("t") <= 200)).groupBy("event_type").agg(F.min("t").alias("threshold"))


@query(
    "role_capped_selection",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS in_role FROM orders), s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN in_role = 1 THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS pick FROM r)
SELECT o_orderkey, CAST(pick AS INTEGER) AS pick, o_orderpriority FROM s WHERE pick <= 7""",
)
def role_capped_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(se.in_order(["o_custkey", "o_orderpriority"], *ORDERED)) == 1
    r = read(spark, sf_dir, "orders").withColumn("__later", F.when(first, 0).otherwise(1))
    return r.withColumn("pick", F.row_number().over(se.in_order(["o_custkey"], "__later", *ORDERED))).where("pick <= 7").select("o_orderkey", "pick", "o_orderpriority")


@query(
    "label_upsert",
    """WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id + 100000000, quality, toxic FROM labels WHERE doc_id % 5 = 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.quality ELSE o.quality END AS quality, CASE WHEN n.doc_id IS NOT NULL THEN n.toxic ELSE o.toxic END AS toxic,
 CASE WHEN n.doc_id IS NULL THEN 'kept' WHEN o.doc_id IS NULL THEN 'appended' WHEN o.quality = n.quality AND o.toxic = n.toxic THEN 'duplicate_skipped' ELSE 'updated' END AS action FROM labels o FULL JOIN n USING (doc_id)""",
)
def label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "labels")
    changed = old.where("doc_id % 2 = 0").withColumn("quality", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    added = old.where("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") + 100000000)
    return st.upsert(old, changed.unionByName(added), ["doc_id"])


@query("hash_manifest", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS n_bytes FROM documents")
def hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    "interval_overlap_join",
    f"""WITH {E_SQL}, a AS (SELECT event_id, user_id, us AS s, us + {2 * HOUR} AS t FROM e WHERE event_type = 'view'), b AS (SELECT user_id, us - {HOUR} AS s, us + {HOUR} AS t FROM e WHERE event_type = 'error')
SELECT a.event_id, count(*) AS n, CAST(sum(least(a.t, b.t) - greatest(a.s, b.s)) AS BIGINT) AS common_us FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.t AND a.t > b.s GROUP BY a.event_id""",
)
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir)
    a = e.where("event_type = 'view'").select("event_id", "user_id", F.col("us").alias("start_us"), (F.col("us") + 2 * HOUR).alias("end_us"))
    b = e.where("event_type = 'error'").select("user_id", (F.col("us") - HOUR).alias("b_start_us"), (F.col("us") + HOUR).alias("b_end_us"))
    return iv.overlaps(a, b, KEY, WIDTH).groupBy("event_id").agg(F.count("*").alias("n"), F.sum(F.col("common_end_us") - F.col("common_start_us")).alias("common_us"))


DAY = 24 * HOUR
# a protocol of contiguous blocks over a day, as the schedule table of range joins
BLOCKS = [("rest", 0, 6), ("gentle", 6, 10), ("handling", 10, 14), ("torso", 14, 20), ("recovery", 20, 24)]
BLOCKS_SQL = "b(name, s, t) AS (VALUES " + ", ".join(f"('{n}', {a * HOUR}, {z * HOUR})" for n, a, z in BLOCKS) + ")"


def protocol(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a * HOUR).cast("long").alias("s"), F.lit(z * HOUR).cast("long").alias("t")) for n, a, z in BLOCKS])
    return spark.range(1).select(F.inline(rows))


@query(
    "protocol_context",
    f"""WITH {E_SQL}, {BLOCKS_SQL}, w AS (SELECT event_id, us % {DAY} AS s, us % {DAY} + {HOUR} AS t FROM e),
m AS (SELECT w.event_id, count(b.name) FILTER (w.s >= b.s AND w.t <= b.t) AS inside, max(CASE WHEN w.s >= b.s AND w.t <= b.t THEN b.name END) AS block, max(CASE WHEN w.s >= b.s AND w.t <= b.t THEN least(w.s - b.s, b.t - w.t) END) AS edge_us FROM w JOIN b ON w.s < b.t AND w.t > b.s GROUP BY w.event_id)
SELECT event_id, CASE WHEN inside = 1 THEN block ELSE 'crosses_activity_block' END AS context, coalesce(edge_us < {HOUR}, true) AS guarded FROM m""",
)
def protocol_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stream(spark, sf_dir).select("event_id", (F.col("us") % DAY).alias("ws"), (F.col("us") % DAY + HOUR).alias("wt"))
    m = w.join(F.broadcast(protocol(spark)), (F.col("ws") < F.col("t")) & (F.col("wt") > F.col("s")))  # five rows
    inside = (F.col("ws") >= F.col("s")) & (F.col("wt") <= F.col("t"))
    m = m.groupBy("event_id").agg(F.count_if(inside).alias("n"), F.max(F.when(inside, F.col("name"))).alias("block"), F.max(F.when(inside, F.least(F.col("ws") - F.col("s"), F.col("t") - F.col("wt")))).alias("edge"))
    return m.select("event_id", F.when(F.col("n") == 1, F.col("block")).otherwise("crosses_activity_block").alias("context"), F.coalesce(F.col("edge") < HOUR, F.lit(True)).alias("guarded"))


@query(
    "latest_per_type",
    f"""WITH {E_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM e)
SELECT user_id, event_type, n, us AS last_us, value AS last_value, k AS last_k FROM r WHERE rn = 1""",
)
def latest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("us", "value", "k"), F.struct("us", "event_id"))
    return stream(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), last.alias("x")).select("user_id", "event_type", "n", F.col("x.us").alias("last_us"), F.col("x.value").alias("last_value"), F.col("x.k").alias("last_k"))


@query("last_n_events", f"WITH {E_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS nth FROM e WHERE event_type = 'error') SELECT event_id, user_id, nth FROM r WHERE nth <= 7")
def last_n_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id")))
    return stream(spark, sf_dir).where("event_type = 'error'").withColumn("nth", nth.cast("long")).where("nth <= 7").select("event_id", "user_id", "nth")


@query("downsample_stride", f"WITH {E_SQL}, r AS (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM e) SELECT event_id, value FROM r WHERE i % 5 = 0")
def downsample_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(se.in_order(KEY, "us", "event_id")) - 1
    return stream(spark, sf_dir).withColumn("i", i).where("i % 5 = 0").select("event_id", "value")


@query(
    "relational_division",
    f"""WITH {E_SQL} SELECT user_id, count(DISTINCT us // {24 * HOUR}) AS days FROM e WHERE value > 20 GROUP BY user_id HAVING count(DISTINCT event_type) = 5""",
)
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stream(spark, sf_dir).where("value > 20").groupBy("user_id").agg(F.countDistinct(F.expr(f"us div {DAY}")).alias("days"), F.countDistinct("event_type").alias("types"))
    return g.where("types = 5").select("user_id", "days")


@query(
    "end_anchored_windows",
    f"""WITH {E_SQL}, l AS (SELECT user_id, max(us) AS last_us FROM e GROUP BY user_id), d AS (SELECT user_id, last_us, dur, unnest(generate_series(0, 3)) AS nth FROM l, (SELECT unnest([{6 * HOUR}, {24 * HOUR}, {72 * HOUR}]) AS dur))
SELECT d.user_id, d.dur AS duration_us, d.nth, count(e.event_id) AS n, max(e.value) AS most FROM d LEFT JOIN e ON e.user_id = d.user_id AND e.us > d.last_us - (d.nth + 1) * d.dur AND e.us <= d.last_us - d.nth * d.dur GROUP BY ALL""",
)
def end_anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of several lengths counted back from each device's end: a row's window is its age over the length."""
    e = stream(spark, sf_dir).withColumn("age", F.max("us").over(Window.partitionBy("user_id")) - F.col("us"))
    lengths = F.explode(F.array(*[F.lit(h * HOUR).cast("long") for h in (6, 24, 72)])).alias("duration_us")
    got = e.select("user_id", "age", "value", lengths).withColumn("nth", F.expr("age div duration_us")).where("nth <= 3").groupBy("user_id", "duration_us", "nth").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    grid = e.select("user_id").distinct().select("user_id", lengths).select("user_id", "duration_us", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("nth"))
    return grid.join(got, ["user_id", "duration_us", "nth"], "left").select("user_id", "duration_us", "nth", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "most")


@query(
    "consensus_cluster",
    f"""WITH {E_SQL}, v AS (SELECT user_id, event_id, value FROM e WHERE event_type = 'view'), c AS (SELECT a.user_id, a.event_id, a.value, count(*) AS members, round(avg(b.value), 6) AS mean FROM v a JOIN v b ON a.user_id = b.user_id AND abs(a.value - b.value) <= 5 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY members DESC, value, event_id) AS rn FROM c)
SELECT user_id, event_id AS centre_id, members, mean FROM r WHERE rn = 1""",
)
def consensus_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centre with most values within 5 of it, of equals the smallest value and then event."""
    v = stream(spark, sf_dir).where("event_type = 'view'").select("user_id", "event_id", "value")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("members"), "centre"))
    best = st.neighbours(v, KEY, "value", 5).withColumn("rn", rn).where("rn = 1")
    first = v.groupBy("user_id", F.col("value").alias("centre")).agg(F.min("event_id").alias("centre_id"))
    return best.join(first, ["user_id", "centre"]).select("user_id", "centre_id", "members", r6("mean").alias("mean"))


@query(
    "review_errors",
    """SELECT source, count(*) FILTER (quality = 1) AS usable, count(*) FILTER (quality = 0) AS unusable, count(*) FILTER (quality IS NULL) AS unscored, count(*) FILTER (quality = 0 AND n_chars >= 500) AS false_accepted, count(*) FILTER (quality = 1 AND n_chars < 500) AS false_rejected,
 round(count(*) FILTER (quality = 0 AND n_chars >= 500) / nullif(count(*) FILTER (quality = 0), 0), 6) AS false_acceptance FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def review_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    good, bad, big = F.col("quality") == 1, F.col("quality") == 0, F.col("n_chars") >= 500
    n = lambda c: F.count_if(c)
    return d.groupBy("source").agg(n(good).alias("usable"), n(bad).alias("unusable"), n(F.col("quality").isNull()).alias("unscored"), n(bad & big).alias("false_accepted"), n(good & ~big).alias("false_rejected"), r6(ratio(n(bad & big), n(bad))).alias("false_acceptance"))


@query(
    "nested_value_counts",
    f"""WITH {E_SQL}, c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT user_id, sum(n) AS total FROM c GROUP BY user_id)
SELECT user_id, event_type, n, round(n / total, 6) AS share FROM c JOIN t USING (user_id)""",
)
def nested_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stream(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.select("user_id", "event_type", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("share"))


@query(
    "contiguity_check",
    f"""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS s FROM orders), n AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey), s) AS t FROM o), g AS (SELECT *, lag(t) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS before FROM n)
SELECT o_custkey, count(*) AS n_blocks, bool_and(before IS NULL OR before = s) AS contiguous, max(t) - min(s) AS span_us FROM g GROUP BY o_custkey""",
)
def contiguity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("s", "o_orderkey")
    n = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").alias("s")).withColumn("t", F.coalesce(F.lead("s").over(w), F.col("s")))
    g = n.withColumn("before", F.lag("t").over(w))
    return g.groupBy("o_custkey").agg(F.count("*").alias("n_blocks"), F.bool_and(F.col("before").isNull() | (F.col("before") == F.col("s"))).alias("contiguous"), (F.max("t") - F.min("s")).alias("span_us"))


@query(
    "policy_decision",
    f"""WITH {PRED_SQL}, b AS (SELECT o_orderpriority, abs(guess - truth) AS a, abs(150 - truth) AS c, guess BETWEEN 50 AND 300 AS kept FROM p WHERE guess IS NOT NULL),
m AS (SELECT o_orderpriority, round(avg(a), 6) AS base_mae, round(avg(c) FILTER (kept), 6) AS candidate_mae, round(count(*) FILTER (kept) / count(*), 6) AS retention FROM b GROUP BY o_orderpriority)
SELECT o_orderpriority, base_mae, candidate_mae, retention, retention >= 0.6 AND candidate_mae - base_mae <= 2 AS accepted FROM m""",
)
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).where("guess is not null")
    kept = F.col("guess").between(50, 300)
    m = p.groupBy("o_orderpriority").agg(r6(F.avg(F.abs(F.col("guess") - F.col("truth")))).alias("base_mae"), r6(F.avg(F.when(kept, F.abs(150 - F.col("truth"))))).alias("candidate_mae"), r6(ratio(F.count_if(kept), F.count("*"))).alias("retention"))
    return m.withColumn("accepted", (F.col("retention") >= 0.6) & (F.col("candidate_mae") - F.col("base_mae") <= 2))


@query(
    "turn_dialogue_stats",
    """WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, count(*) FILTER (before = role) AS repeated_roles, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(turn) AS first_turn FROM c GROUP BY conv_id""",
)
def turn_dialogue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.count_if(F.col("before") == F.col("role")).alias("repeated_roles"), F.sum(F.length("text")).alias("n_chars"), F.min("turn").alias("first_turn"))
