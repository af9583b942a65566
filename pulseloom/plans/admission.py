"""Queries of the admission rules: health, streams, contact, eligibility, labels, pairing. See catalogue for the roles of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import MAD_SCALE, band, median, r6, reasons
from ..operators import series as se
from .catalogue import E_SQL, GAP, HOUR, KEY, STEP, WIDTH, read, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def counted(c: str) -> Column:
    """A health counter as text, as status lines have it: blank, absent, broken, negative, zero or more."""
    k = F.col(c) % 6
    return F.when(k == 0, "").when(k == 1, F.lit(None)).when(k == 2, "bad").when(k == 3, "-1").when(k == 4, "0").otherwise((F.col(c) % 4).cast("string"))


def counted_sql(c: str) -> str:
    return f"CASE {c} % 6 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'bad' WHEN 3 THEN '-1' WHEN 4 THEN '0' ELSE CAST({c} % 4 AS VARCHAR) END"


def _strict_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL WHEN TRY_CAST({c} AS DOUBLE) IS NULL OR TRY_CAST({c} AS DOUBLE) < 0 THEN 'invalid_sensor_health_counter:{c}' WHEN TRY_CAST({c} AS DOUBLE) > 0 THEN 'sensor_health_error:{c}=' || {c} END"


def _unknown_sql(c: str) -> str:
    return f"CASE WHEN TRY_CAST({c} AS DOUBLE) IS NULL THEN 'unknown_sensor_health:{c}' WHEN TRY_CAST({c} AS DOUBLE) <> 0 THEN 'sensor_health:{c}' END"


def sorted_sql(*parts: str) -> str:
    """The entries that are not null, sorted, joined by semicolons."""
    return f"array_to_string(list_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), ';')"


@query(
    f"""WITH c AS (SELECT o_orderkey, {counted_sql("o_orderkey")} AS i2c, {counted_sql("o_custkey")} AS ovf FROM orders)
SELECT o_orderkey, {sorted_sql(_strict_sql("i2c"), _strict_sql("ovf"))} AS strict_reasons,
 {sorted_sql("CASE WHEN i2c IS NULL OR i2c = '' THEN 'missing_sensor_health_counter:i2c' END", "CASE WHEN ovf IS NULL OR ovf = '' THEN 'missing_sensor_health_counter:ovf' END")} AS warnings,
 {sorted_sql(_unknown_sql("i2c"), _unknown_sql("ovf"))} AS motion_reasons FROM c"""
)
def sensor_health_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {"i2c": counted("o_orderkey"), "ovf": counted("o_custkey")}
    return read(spark, sf_dir, "orders").select("o_orderkey", R.counter_reasons(c).alias("strict_reasons"), R.counter_warnings(c).alias("warnings"), R.unknown_counter_reasons(c).alias("motion_reasons"))


@query(
    f"""WITH {E_SQL}, d AS (SELECT user_id, event_id, us, us - lag(us) OVER w AS dt, event_id - lag(event_id) OVER w AS dseq, k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
m AS (SELECT user_id, count(*) AS n, quantile_cont(dt, 0.5) AS mid, max(dt) AS longest, count(*) FILTER (dt <= 0) AS backward, count(*) FILTER (dseq <= 0) AS back_seq, count(*) FILTER (dseq > 1) AS jumps, max(k) % 3 AS s FROM d GROUP BY user_id)
SELECT user_id, {sorted_sql("CASE WHEN n < 2 OR (backward = 0 AND mid > 0 AND longest > 1.5 * mid) THEN 'missing_timestamps' END", "CASE WHEN backward > 0 THEN 'non_monotonic_timestamps' END", "CASE WHEN back_seq > 0 THEN 'non_monotonic_sequences' END", "CASE WHEN jumps > 0 THEN 'missing_sequences' END", "CASE WHEN s = 0 THEN 'unresolved_quality_status:poor' WHEN s = 1 THEN 'unresolved_quality_status:uncertain' END")} AS rejection FROM m"""
)
def recording_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = se.with_deltas(stream(spark, sf_dir), KEY, "us", "event_id")
    m = d.groupBy("user_id").agg(
        F.count("*").alias("n"), median("dt").alias("mid"), F.max("dt").alias("longest"), F.count_if(F.col("dt") <= 0).alias("backward"),
        F.count_if(F.col("dseq") <= 0).alias("back_seq"), F.count_if(F.col("dseq") > 1).alias("jumps"), (F.max("k") % 3).alias("s"),
    )
    status = F.when(F.col("s") == 0, "poor").when(F.col("s") == 1, "uncertain").otherwise("usable")
    held = R.joined(
        [
            F.when((F.col("n") < 2) | ((F.col("backward") == 0) & (F.col("mid") > 0) & (F.col("longest") > 1.5 * F.col("mid"))), "missing_timestamps"),
            F.when(F.col("backward") > 0, "non_monotonic_timestamps"),
            F.when(F.col("back_seq") > 0, "non_monotonic_sequences"),
            F.when(F.col("jumps") > 0, "missing_sequences"),
            F.when(status.isin(R.REJECTED_STATUSES), F.concat(F.lit("unresolved_quality_status:"), status)),
        ]
    )
    return m.select("user_id", held.alias("rejection"))


@query(
    f"""WITH {E_SQL}, d AS (SELECT user_id, us - lag(us) OVER w AS dt, event_id - lag(event_id) OVER w AS dseq FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
m AS (SELECT user_id, count(*) AS n, count(*) FILTER (dseq <> 1) AS odd, count(*) FILTER (dt <= 0) AS backward, count(*) FILTER (dt > {GAP}) AS long FROM d GROUP BY user_id)
SELECT user_id, CASE WHEN n < 2 THEN 'missing_or_empty_stream' ELSE {sorted_sql("CASE WHEN odd > 0 THEN 'sequence_discontinuity' END", "CASE WHEN backward > 0 THEN 'nonmonotonic_time' END", "CASE WHEN long > 0 THEN 'timestamp_gap' END")} END AS reasons,
 {sorted_sql("CASE WHEN odd > 0 THEN 'ppg_missing_or_non_monotonic_sequence' END", "CASE WHEN backward > 0 THEN 'ppg_non_monotonic_timestamp' END")} AS strict_reasons FROM m"""
)
def stream_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = se.with_deltas(stream(spark, sf_dir), KEY, "us", "event_id")
    m = d.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("dseq") != 1).alias("odd"), F.count_if(F.col("dt") <= 0).alias("backward"), F.count_if(F.col("dt") > GAP).alias("long"))
    strict = reasons(("ppg_missing_or_non_monotonic_sequence", F.col("odd") > 0), ("ppg_non_monotonic_timestamp", F.col("backward") > 0))
    return m.select("user_id", R.stream_reasons(F.col("n"), F.col("odd"), F.col("backward"), F.col("long")).alias("reasons"), strict.alias("strict_reasons"))


@query(
    f"""WITH {E_SQL}, d AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS dt FROM e),
m AS (SELECT user_id, count(*) AS n, quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) AS mid, count(*) FILTER (dt <= 0) AS backward FROM d GROUP BY user_id)
SELECT user_id, round(3600e6 / mid, 6) AS rate_per_hour, CASE WHEN n < 4 THEN 'too_short' WHEN backward > 0 THEN 'not_increasing' WHEN mid IS NULL THEN 'no_rate' WHEN 3600e6 / mid < 0.05 OR 3600e6 / mid > 0.5 THEN 'rate_outside' ELSE 'admitted' END AS status FROM m"""
)
def rate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict read of a two-column signal, and its rate against a band."""
    d = se.with_deltas(stream(spark, sf_dir), KEY, "us", "event_id")
    m = d.groupBy("user_id").agg(F.count("*").alias("n"), median(F.when(F.col("dt") > 0, F.col("dt"))).alias("mid"), F.count_if(F.col("dt") <= 0).alias("backward"))
    rate = F.lit(3600e6) / F.col("mid")
    status = F.when(F.col("n") < 4, "too_short").when(F.col("backward") > 0, "not_increasing").when(F.col("mid").isNull(), "no_rate").when(~rate.between(0.05, 0.5), "rate_outside").otherwise("admitted")
    return m.select("user_id", r6(rate).alias("rate_per_hour"), status.alias("status"))


@query(
    f"""WITH {E_SQL} SELECT event_id, round(sqrt(CAST(k AS DOUBLE) * k + value * value + CAST(event_id % 512 - 256 AS DOUBLE) * (event_id % 512 - 256)) * {R.G_PER_COUNT * R.METRES!r}, 6) AS metres FROM e"""
)
def axes_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: c.cast("double")
    return stream(spark, sf_dir).select("event_id", r6(R.axes_magnitude(d(F.col("k")), F.col("value"), d(F.col("event_id") % 512 - 256))).alias("metres"))


QD_SQL = "SELECT l_orderkey, l_linenumber, l_discount AS activity, l_quantity * 2000 AS contact, l_tax / 4 AS clipped, l_extendedprice / 100000 AS template, l_tax AS cv, CAST(l_quantity AS BIGINT) AS beats, l_returnflag <> 'R' AS morphology FROM lineitem"


@query(
    f"""WITH f AS ({QD_SQL}), s AS (SELECT *, CASE WHEN activity IS NULL OR activity < 0 THEN 'unknown' WHEN activity < 0.02 THEN 'stationary' WHEN activity < 0.05 THEN 'mild' WHEN activity < 0.09 THEN 'moderate' ELSE 'severe' END AS severity FROM f),
r AS (SELECT *, CASE WHEN severity = 'unknown' THEN 'uncertain' WHEN contact < 10000 OR clipped > 0.015 OR severity = 'severe' THEN 'unrecoverable' WHEN NOT (template >= 0.3 AND cv <= 0.05 AND beats >= 8 AND morphology) THEN 'uncertain' WHEN severity = 'stationary' THEN 'preserved' ELSE 'potentially_recoverable' END AS recoverability FROM s)
SELECT severity, recoverability, recoverability IN ('preserved', 'potentially_recoverable') AS eligible, count(*) AS n FROM r GROUP BY ALL"""
)
def signal_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read(spark, sf_dir, "lineitem").select(
        F.col("l_discount").alias("activity"), (F.col("l_quantity") * 2000).alias("contact"), (F.col("l_tax") / 4).alias("clipped"), (F.col("l_extendedprice") / 100000).alias("template"),
        F.col("l_tax").alias("cv"), F.col("l_quantity").cast("long").alias("beats"), (F.col("l_returnflag") != "R").alias("morphology"),
    )
    severity = band(F.col("activity"), [0.02, 0.05, 0.09], ["stationary", "mild", "moderate", "severe"])
    checks = [F.col("template") >= 0.3, F.col("cv") <= 0.05, F.col("beats") >= 8, F.col("morphology")]
    state, eligible = R.signal_decision(severity, F.lit(True), F.col("contact"), F.col("clipped"), checks, 10000, 0.015)
    return f.select(severity.alias("severity"), state.alias("recoverability"), eligible.alias("eligible")).groupBy("severity", "recoverability", "eligible").agg(F.count("*").alias("n"))


@query(
    f"""WITH {E_SQL}, g AS (SELECT user_id, us // {24 * HOUR} AS day, count(*) FILTER (value <= 1) AS clipped, max(value) - min(value) AS step, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS spread, count(*) FILTER (event_type = 'error') > 0 AS moving, count(*) >= 3 AS morphology FROM e GROUP BY ALL)
SELECT user_id, day, CASE WHEN clipped > 0 OR step * 20 > greatest(1000.0, 6.0 * spread * 20) THEN 'contact_corrupted' WHEN moving THEN 'motion_corrupted' WHEN morphology THEN 'clean' ELSE 'uncertain' END AS suggested FROM g"""
)
def suggested_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.percentile("value", F.lit(p))
    g = stream(spark, sf_dir).groupBy("user_id", F.expr(f"us div {24 * HOUR}").alias("day")).agg(
        F.count_if(F.col("value") <= 1).alias("clipped"), (F.max("value") - F.min("value")).alias("step"), (q(0.75) - q(0.25)).alias("spread"), (F.count_if(F.col("event_type") == "error") > 0).alias("moving"), (F.count("*") >= 3).alias("morphology")
    )
    label = R.suggested_label(F.col("clipped"), F.col("step") * 20, F.col("spread") * 20, F.col("moving"), F.col("morphology"))
    return g.select("user_id", "day", label.alias("suggested"))


@query(
    """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'cuff' ELSE 'continuous' END AS kind, CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS valid, o_orderstatus <> 'P' AS aligned, o_orderkey % 10 AS a, o_orderkey % 10 + o_custkey % 4 AS b, o_orderkey % 10 + 5 AS c, o_orderkey % 10 + 4 + o_custkey % 3 AS d,
 o_totalprice / 1000 AS sbp, 50.0 AS dbp, CASE WHEN o_custkey % 11 = 0 THEN 'short' ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS digest FROM orders)
SELECT o_orderkey, coalesce(kind = 'continuous' AND valid AND aligned AND a <= b AND b < c AND c <= d AND dbp > 0 AND dbp < sbp AND length(digest) = 64, FALSE) AS usable FROM r"""
)
def reference_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    valid = F.when(c % 7 == 0, F.lit(None)).otherwise(c % 7 != 1)
    digest = F.when(c % 11 == 0, "short").otherwise(F.sha2(k.cast("string"), 256))
    usable = R.reference_usable(F.when(k % 5 == 0, "cuff").otherwise("continuous"), valid, F.col("o_orderstatus") != "P", k % 10, k % 10 + c % 4, k % 10 + 5, k % 10 + 4 + c % 3, F.col("o_totalprice") / 1000, F.lit(50.0), digest)
    return read(spark, sf_dir, "orders").select("o_orderkey", usable.alias("usable"))


@query(
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 2 ELSE 0 END AS missing, CASE o_orderkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'usable' WHEN 2 THEN 'borderline' ELSE 'reject' END AS timing, o_custkey % 20 AS peaks,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 2000 END AS bpm, o_totalprice / 2000 - 75 AS off, o_totalprice / 100 AS span, o_orderpriority = '1-URGENT' AS warned FROM orders)
SELECT o_orderkey, CASE WHEN missing > 0 OR timing = 'reject' OR bpm IS NULL OR NOT bpm BETWEEN 40 AND 180 OR peaks < 3 THEN 'reject' WHEN timing = 'borderline' OR warned OR abs(off) > 10 OR span < 1000 THEN 'borderline' ELSE 'usable' END AS quality,
 CASE WHEN missing > 0 THEN 'missing_samples' WHEN timing = 'reject' THEN 'timing' WHEN bpm IS NULL OR NOT bpm BETWEEN 40 AND 180 THEN 'rate' WHEN peaks < 3 THEN 'peaks' ELSE concat_ws(';', CASE WHEN timing = 'borderline' THEN 'timing' END, CASE WHEN warned THEN 'warnings' END, CASE WHEN abs(off) > 10 THEN 'cuff' END, CASE WHEN span < 1000 THEN 'span' END) END AS why FROM t"""
)
def analysis_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    timing = F.element_at(F.array(*map(F.lit, ("good", "usable", "borderline", "reject"))), (k % 4 + 1).cast("int"))
    quality, why = R.analysis_quality(F.when(c % 9 == 0, 2).otherwise(0), timing, c % 20, F.when(k % 13 != 0, p / 2000), p / 2000 - 75, p / 100, F.col("o_orderpriority") == "1-URGENT")
    return read(spark, sf_dir, "orders").select("o_orderkey", quality.alias("quality"), why.alias("why"))


@query(
    """WITH w AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'usable' WHEN 2 THEN 'borderline' END AS timing, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Timestamp lag' WHEN 3 THEN 'low contact | old TIMESTAMPS' ELSE 'low contact' END AS txt FROM orders),
l AS (SELECT *, CASE WHEN txt IS NULL OR trim(txt) = '' THEN [] ELSE list_filter(list_transform(string_split(txt, '|'), lambda x: trim(x)), lambda x: x <> '') END AS ws, coalesce(timing IN ('good', 'usable'), FALSE) AS lenient FROM w)
SELECT o_orderkey, array_to_string(list_filter(ws, lambda x: NOT (lenient AND contains(lower(x), 'timestamp'))), ';') AS effective, array_to_string(list_filter(ws, lambda x: lenient AND contains(lower(x), 'timestamp')), ';') AS ignored FROM l"""
)
def warning_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 5
    timing = F.when(k == 0, "good").when(k == 1, "usable").when(k == 2, "borderline")
    text = F.when(c == 0, F.lit(None)).when(c == 1, " ").when(c == 2, "Timestamp lag").when(c == 3, "low contact | old TIMESTAMPS").otherwise("low contact")
    kept, aside = R.effective_warnings(timing, R.warning_list(text))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(kept, ";").alias("effective"), F.array_join(aside, ";").alias("ignored"))


@query(
    """WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'p1_recovery' WHEN 1 THEN 'p1_Stationary2' WHEN 2 THEN 'p1-calibration_01' WHEN 3 THEN 'p1_walk' ELSE '' END AS id FROM orders), l AS (SELECT *, lower(regexp_extract(id, '([A-Za-z]+)[0-9_]*$', 1)) AS last FROM n)
SELECT o_orderkey, CASE WHEN last IN ('recovery', 'stationary', 'calibration') THEN last ELSE 'other' END AS role, regexp_matches(id, '^[A-Za-z0-9][A-Za-z0-9_.-]*$') AS is_identity FROM l"""
)
def identity_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, "p1_recovery").when(k == 1, "p1_Stationary2").when(k == 2, "p1-calibration_01").when(k == 3, "p1_walk").otherwise("")
    return read(spark, sf_dir, "orders").select("o_orderkey", R.role_of(name).alias("role"), name.rlike("^[A-Za-z0-9][A-Za-z0-9_.-]*$").alias("is_identity"))


@query(
    f"""WITH {E_SQL}, s AS (SELECT user_id, us // {24 * HOUR} AS day, quantile_cont(value, 0.5) AS mid FROM e GROUP BY ALL),
d AS (SELECT *, abs(mid - lag(mid) OVER (PARTITION BY user_id ORDER BY day)) AS step FROM s),
m AS (SELECT user_id, quantile_cont(step, 0.5) AS c, count(*) AS n FROM d GROUP BY user_id),
t AS (SELECT d.user_id, any_value(n) AS n, any_value(c) AS c, {MAD_SCALE} * quantile_cont(abs(step - c), 0.5) AS mad FROM d JOIN m USING (user_id) GROUP BY d.user_id),
b AS (SELECT d.user_id, d.day * {24 * HOUR} AS at FROM d JOIN t USING (user_id) WHERE n >= 3 AND step > greatest(c + 1.0 * mad, 2.220446049250313e-16))
SELECT event_id, value <= 16 OR value >= 480 AS clipped, value < 50 AS poor_contact, EXISTS (SELECT 1 FROM b WHERE b.user_id = e.user_id AND abs(e.us - b.at) <= {2 * HOUR}) AS contact_step FROM e"""
)
def contact_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipping, poor contact, and the margin around days whose median steps by more than a robust threshold."""
    e = stream(spark, sf_dir)
    day = 24 * HOUR
    s = e.groupBy("user_id", F.expr(f"us div {day}").alias("day")).agg(median("value").alias("mid"))
    d = s.withColumn("step", F.abs(F.col("mid") - F.lag("mid").over(se.in_order(KEY, "day"))))
    t = se.robust_thresholds(d.where("step is not null").select(*KEY, "step"), KEY, "step", 1.0)
    n = d.groupBy("user_id").agg(F.count("*").alias("days")).where("days >= 3")
    b = d.join(t, "user_id").join(n, "user_id", "left_semi").where(F.col("step") > F.greatest("threshold", F.lit(2.220446049250313e-16)))
    # the margin in hourly slots, so that it is found by an equi-join
    near = b.select("user_id", (F.col("day") * day).alias("at")).withColumn("slot", F.explode(F.sequence(F.floor((F.col("at") - 2 * HOUR) / HOUR), F.floor((F.col("at") + 2 * HOUR) / HOUR))))
    hit = e.withColumn("slot", F.floor(F.col("us") / HOUR)).join(near, ["user_id", "slot"]).where(F.abs(F.col("us") - F.col("at")) <= 2 * HOUR).select("event_id").distinct().withColumn("hit", F.lit(True))
    return e.join(hit, "event_id", "left").select("event_id", ((F.col("value") <= 16) | (F.col("value") >= 480)).alias("clipped"), (F.col("value") < 50).alias("poor_contact"), F.coalesce("hit", F.lit(False)).alias("contact_step"))


@query(
    f"""WITH {E_SQL}, r AS (SELECT *, us - min(us) OVER (PARTITION BY user_id) AS t, max(us) OVER (PARTITION BY user_id) - us AS left_us FROM e)
SELECT event_id, t < {5 * HOUR} OR left_us < {5 * HOUR} AS edge FROM r"""
)
def edge_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    return stream(spark, sf_dir).select("event_id", ((F.col("us") - F.min("us").over(w) < 5 * HOUR) | (F.max("us").over(w) - F.col("us") < 5 * HOUR)).alias("edge"))


@query(
    f"""WITH {E_SQL}, w AS (SELECT DISTINCT user_id, us // {STEP} * {STEP} - {2 * HOUR} AS s FROM e), x AS (SELECT user_id, s, s + {WIDTH} AS z, (SELECT min(us // {24 * HOUR}) * {24 * HOUR} FROM e) AS t0, (SELECT max(us // {24 * HOUR}) * {24 * HOUR} + {24 * HOUR} FROM e) AS t1 FROM w)
SELECT user_id, s AS start_us, CASE WHEN s // {24 * HOUR} = (z - 1) // {24 * HOUR} AND s >= t0 AND z <= t1 THEN s // {24 * HOUR} END AS block,
 {sorted_sql(f"CASE WHEN NOT (s // {24 * HOUR} = (z - 1) // {24 * HOUR} AND s >= t0 AND z <= t1) THEN 'crosses_activity_block' END", f"CASE WHEN s < t0 + {5 * HOUR} OR z > t1 - {5 * HOUR} THEN 'recording_edge_guard' END", f"CASE WHEN (s - {HOUR} < (z + {HOUR} - 1) // {24 * HOUR} * {24 * HOUR}) AND (z + {HOUR} - 1) // {24 * HOUR} * {24 * HOUR} > t0 AND (z + {HOUR} - 1) // {24 * HOUR} * {24 * HOUR} < t1 THEN 'cue_transition_guard' END", f"CASE WHEN (z - 1) // {24 * HOUR} % 7 = 0 AND s < (z - 1) // {24 * HOUR} * {24 * HOUR} + {6 * HOUR} OR s // {24 * HOUR} % 7 = 0 AND s < s // {24 * HOUR} * {24 * HOUR} + {6 * HOUR} THEN 'early_recovery_guard' END")} AS reasons FROM x"""
)
def protocol_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows against day-long protocol blocks: containment, edges, cue changes, and the start of recovery blocks (every 7th day)."""
    day = 24 * HOUR
    e = stream(spark, sf_dir)
    span = e.agg((F.min(F.expr(f"us div {day}")) * day).alias("t0"), (F.max(F.expr(f"us div {day}")) * day + day).alias("t1"))  # one row
    w = e.select("user_id", (F.expr(f"us div {STEP}") * STEP - 2 * HOUR).alias("start_us")).distinct().crossJoin(F.broadcast(span))
    s = F.col("start_us")
    z = s + WIDTH
    first, last = F.floor(s / day), F.floor((z - 1) / day)
    inside = (first == last) & (s >= F.col("t0")) & (z <= F.col("t1"))
    cue = F.floor((z + HOUR - 1) / day) * day  # the last boundary that the window with its margin reaches
    held = reasons(
        ("crosses_activity_block", ~inside),
        ("recording_edge_guard", (s < F.col("t0") + 5 * HOUR) | (z > F.col("t1") - 5 * HOUR)),
        ("cue_transition_guard", (s - HOUR < cue) & (cue > F.col("t0")) & (cue < F.col("t1"))),
        ("early_recovery_guard", ((last % 7 == 0) & (s < last * day + 6 * HOUR)) | ((first % 7 == 0) & (s < first * day + 6 * HOUR))),
    )
    return w.select("user_id", "start_us", F.when(inside, first).alias("block"), held.alias("reasons"))


@query(
    """WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(n_chars AS VARCHAR) || '.0' WHEN 2 THEN source ELSE CAST(n_chars + 1 AS VARCHAR) END AS given FROM documents), b AS (SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 2 THEN d.source ELSE CAST(d.n_chars AS VARCHAR) END AS measured, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT labelled, CASE WHEN trim(given) = '' OR coalesce(abs(TRY_CAST(given AS DOUBLE) - TRY_CAST(measured AS DOUBLE)) <= 1e-9, trim(given) = trim(measured)) THEN 'agrees' ELSE 'conflict' END AS verdict, count(*) AS n, CAST(sum(length(CASE WHEN trim(given) = '' THEN measured ELSE given END)) AS BIGINT) AS merged_chars FROM a JOIN b USING (doc_id) GROUP BY ALL"""
)
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to measurements one to one; a blank label is filled, one that differs is a conflict."""
    d = read(spark, sf_dir, "documents")
    n, k = F.col("n_chars").cast("string"), F.col("doc_id") % 4
    given = F.when(k == 0, "").when(k == 1, F.concat(n, F.lit(".0"))).when(k == 2, F.col("source")).otherwise((F.col("n_chars") + 1).cast("string"))
    both = d.select("doc_id", given.alias("given"), F.when(k == 2, F.col("source")).otherwise(n).alias("measured")).join(read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    merged = F.when(F.trim("given") == "", F.col("measured")).otherwise(F.col("given"))
    g = both.groupBy(F.coalesce("labelled", F.lit(False)).alias("labelled"), F.when(R.values_agree(F.col("given"), F.col("measured")), "agrees").otherwise("conflict").alias("verdict"))
    return g.agg(F.count("*").alias("n"), F.sum(F.length(merged)).alias("merged_chars"))


@query(
    f"""WITH {E_SQL}, l AS (SELECT user_id, max(us) FILTER (event_type = 'view') AS v, max(us) FILTER (event_type = 'click') AS c, max(us) AS now FROM e GROUP BY user_id)
SELECT user_id, {sorted_sql(f"CASE WHEN v IS NULL OR now - v > {GAP} THEN 'view' END", f"CASE WHEN c IS NULL OR now - c > {GAP} THEN 'click' END")} AS overdue FROM l"""
)
def overdue_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda t: F.max(F.when(F.col("event_type") == t, F.col("us"))).alias(t)
    g = stream(spark, sf_dir).groupBy("user_id").agg(last("view"), last("click"), F.max("us").alias("now"))
    late = lambda t: F.col(t).isNull() | (F.col("now") - F.col(t) > GAP)
    return g.select("user_id", reasons(("view", late("view")), ("click", late("click"))).alias("overdue"))


@query(
    f"""WITH {E_SQL}, l AS (SELECT event_id, user_id, us, last_value(CASE WHEN event_type IN ('error', 'signup') THEN us END IGNORE NULLS) OVER w AS m_us, last_value(CASE WHEN event_type IN ('error', 'signup') THEN CASE WHEN event_type = 'error' THEN 'moving' WHEN k % 3 = 0 THEN 'calibrating' ELSE 'still' END END IGNORE NULLS) OVER w AS status, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS quiet FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN m_us IS NULL THEN 'motion_unknown' WHEN us - m_us > {2 * GAP} THEN 'motion_stale' WHEN status = 'moving' THEN 'motion_detected' WHEN status = 'calibrating' THEN 'calibrating' END AS gate, CASE WHEN quiet IS NULL THEN 'waiting' WHEN quiet > {GAP} THEN 'stale' ELSE 'connected' END AS connection FROM l"""
)
def live_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds an estimate back at each row: the latest motion status, its age, and the age of the connection."""
    w = se.in_order(KEY, "us", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    status = F.when(F.col("event_type") == "error", "moving").when(F.col("event_type") == "signup", F.when(F.col("k") % 3 == 0, "calibrating").otherwise("still"))
    e = stream(spark, sf_dir).withColumn("status", status)
    d = e.select("event_id", (F.col("us") - F.last(F.when(F.col("status").isNotNull(), F.col("us")), True).over(upto)).alias("age"), F.last("status", True).over(upto).alias("status"), (F.col("us") - F.lag("us").over(w)).alias("quiet"))
    return d.select("event_id", R.live_gate(F.col("age"), F.col("status"), 2 * GAP).alias("gate"), R.connection(F.col("quiet"), GAP).alias("connection"))


@query(
    """WITH f AS (SELECT DISTINCT event_type || '_' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS name FROM events)
SELECT name, starts_with(name, 'error_') OR name IN ('click_1', 'view_0') AS forbidden FROM f"""
)
def forbidden_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature names that may not reach a model: reserved ones, and those with a reserved beginning."""
    f = stream(spark, sf_dir).select(F.concat_ws("_", "event_type", (F.col("k") % 5).cast("string")).alias("name")).distinct()
    return f.select("name", (F.col("name").startswith("error_") | F.col("name").isin("click_1", "view_0")).alias("forbidden"))


@query(
    """WITH m AS (SELECT vec_id AS id FROM embeddings), c AS (SELECT page_id * 2 AS id FROM pages), j AS (SELECT coalesce(m.id, c.id) AS id, m.id IS NOT NULL AS has_meta, c.id IS NOT NULL AS has_csv FROM m FULL OUTER JOIN c ON m.id = c.id)
SELECT id, CASE WHEN has_meta AND has_csv THEN 'paired' WHEN has_meta THEN 'missing_csv' ELSE 'orphan_csv' END AS status, NOT has_meta AS inferred FROM j"""
)
def trial_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and signal files paired in full; what stands alone keeps its place with a status."""
    m = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("meta"))
    c = read(spark, sf_dir, "pages").select((F.col("page_id") * 2).alias("id"), F.lit(True).alias("csv"))
    status = F.when(F.col("meta") & F.col("csv"), "paired").when(F.col("meta"), "missing_csv").otherwise("orphan_csv")
    return m.join(c, "id", "full").select("id", status.alias("status"), F.col("meta").isNull().alias("inferred"))


@query(
    """WITH s AS (SELECT n_nationkey, n_name, n_nationkey % 5 <> 4 AS enabled, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 3 = 0 GROUP BY ALL)
SELECT n_name, CASE WHEN NOT enabled THEN 'disabled' WHEN n = 0 AND n_nationkey % 2 = 0 THEN 'missing_required' WHEN n = 0 THEN 'not_installed' ELSE 'available' END AS status, n FROM s"""
)
def adapter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configured source with what became of it, also those that have nothing."""
    n = read(spark, sf_dir, "nation")
    found = read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    d = n.join(found, "n_nationkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n_nationkey") % 5 == 4, "disabled").when((F.col("n") == 0) & (F.col("n_nationkey") % 2 == 0), "missing_required").when(F.col("n") == 0, "not_installed").otherwise("available")
    return d.select("n_name", status.alias("status"), "n")


@query(
    """WITH b AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prior, count(*) OVER (PARTITION BY conv_id, turn) AS same, count(DISTINCT role) OVER (PARTITION BY conv_id) AS roles, length(trim(coalesce(text, ''))) = 0 AS blank FROM conversations)
SELECT conv_id, CASE WHEN max(same) > 1 THEN 'duplicate' WHEN bool_or(blank) THEN 'incomplete' WHEN min(turn) > (SELECT min(turn) FROM conversations) OR bool_or(prior IS NOT NULL AND turn <> prior + 1) THEN 'non_continuous' WHEN max(roles) < 2 THEN 'one_sided' ELSE 'valid' END AS status, count(*) AS blocks FROM b GROUP BY conv_id"""
)
def annotation_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A protocol's blocks: no duplicates, complete, from the first on without a hole."""
    c = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id")
    first = c.agg(F.min("turn").alias("first"))  # one row
    b = c.select("conv_id", "turn", "role", F.lag("turn").over(w.orderBy("turn")).alias("prior"), (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).alias("blank"))
    g = b.groupBy("conv_id").agg(F.count("*").alias("blocks"), F.countDistinct("turn").alias("turns"), F.bool_or("blank").alias("blank"), F.min("turn").alias("least"), F.count_if(F.col("turn") != F.col("prior") + 1).alias("holes"), F.countDistinct("role").alias("roles"))
    g = g.crossJoin(F.broadcast(first))
    status = F.when(F.col("blocks") > F.col("turns"), "duplicate").when(F.col("blank"), "incomplete").when((F.col("least") > F.col("first")) | (F.col("holes") > 0), "non_continuous").when(F.col("roles") < 2, "one_sided").otherwise("valid")
    return g.select("conv_id", status.alias("status"), "blocks")


@query(
    """WITH a AS (SELECT doc_id AS id, source, n_chars, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT page_id, NULL, NULL, url FROM pages)
SELECT id % 100 AS bucket, count(*) AS n, count(DISTINCT id) AS ids, count(*) - count(DISTINCT id) AS repeats, count(source) AS n_source, count(url) AS n_url FROM a GROUP BY ALL"""
)
def ragged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different columns united by name, and the ids that stand in it more than once."""
    a = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars").unionByName(read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)
    return a.groupBy((F.col("id") % 100).alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), (F.count("*") - F.countDistinct("id")).alias("repeats"), F.count("source").alias("n_source"), F.count("url").alias("n_url"))
