"""Queries that compose studies: windows, splits, pairing of runs, decisions, and live rules as batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import band, median, r6, ratio, reasons
from ..operators import intervals as iv
from ..operators import series as se
from ..operators import studies as st
from .admission import sorted_sql
from .catalogue import E_SQL, GAP, HOUR, KEY, O_WIN, ORDERED, PRED_SQL, STEP, WIDTH, predictions, read, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = 24 * HOUR
E_WIN = "PARTITION BY user_id ORDER BY us, event_id"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(
    f"""WITH {E_SQL}, r AS (SELECT user_id, us // {DAY} AS rec, min(us) AS a, max(us) AS z FROM e GROUP BY ALL),
w AS (SELECT user_id, rec, unnest(CASE WHEN z - a < {WIDTH} THEN [a] ELSE generate_series(a, z - {WIDTH}, {STEP}) END) AS s, a, z FROM r)
SELECT user_id, rec, s AS start_us, CASE WHEN z - a < {WIDTH} THEN z ELSE s + {WIDTH} END AS end_us, z - a < {WIDTH} AS short FROM w"""
)
def window_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows from a recording's start on; a recording shorter than one is a single closed window."""
    r = stream(spark, sf_dir).groupBy("user_id", F.expr(f"us div {DAY}").alias("rec")).agg(F.min("us").alias("a"), F.max("us").alias("z"))
    short = F.col("z") - F.col("a") < WIDTH
    starts = F.when(short, F.array("a")).otherwise(F.sequence("a", F.greatest("a", F.col("z") - WIDTH), F.lit(STEP).cast("long")))
    w = r.select("user_id", "rec", "z", short.alias("short"), F.explode(starts).alias("start_us"))
    return w.select("user_id", "rec", "start_us", F.when(F.col("short"), F.col("z")).otherwise(F.col("start_us") + WIDTH).alias("end_us"), "short")


@query(
    f"""WITH RECURSIVE {E_SQL}, c AS (SELECT DISTINCT user_id, s FROM (SELECT user_id, us // {STEP} * {STEP} AS s FROM e UNION ALL SELECT user_id, us FROM e WHERE event_type = 'signup')),
k AS (SELECT user_id, min(s) AS s FROM c GROUP BY user_id UNION ALL SELECT k.user_id, min(c.s) AS s FROM k JOIN c ON c.user_id = k.user_id AND c.s > k.s + {HOUR} GROUP BY k.user_id, k.s)
SELECT user_id, s AS start_us FROM k"""
)
def aligned_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid starts and run starts together; one within an hour of the last that was kept is left out."""
    e = stream(spark, sf_dir)
    c = e.select("user_id", (F.expr(f"us div {STEP}") * STEP).alias("start_us")).unionByName(e.where("event_type = 'signup'").select("user_id", F.col("us").alias("start_us"))).distinct()
    return se.thinned(c, KEY, "start_us", HOUR)


@query(
    """WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, CASE WHEN p <= floor(0.6 * n) THEN 'train' WHEN p <= floor(0.8 * n) THEN 'calibration' ELSE 'test' END AS part FROM f"""
)
def split_60_20_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    p, n = F.row_number().over(w.orderBy(*ORDERED)), F.count(F.lit(1)).over(w)
    part = F.when(p <= F.floor(n * F.lit(0.6)), "train").when(p <= F.floor(n * F.lit(0.8)), "calibration").otherwise("test")
    return read(spark, sf_dir, "orders").select("o_orderkey", part.alias("part"))


@query(
    """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS rank FROM g)
SELECT o_custkey, n, CASE WHEN (rank // 5) % 2 = 0 THEN rank % 5 ELSE 4 - rank % 5 END AS fold FROM r"""
)
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups in five folds of near equal size: largest first, to and fro over the folds."""
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rank = st.ranked(g, F.desc("n"), F.col("o_custkey"))
    fold = F.when(F.floor(F.col("rank") / 5) % 2 == 0, F.col("rank") % 5).otherwise(4 - F.col("rank") % 5)
    return rank.select("o_custkey", "n", fold.alias("fold"))


@query(
    """WITH g AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders)
SELECT o_custkey, 'trial_' || CAST(o_orderkey AS VARCHAR) AS held_out, count(*) OVER (PARTITION BY o_custkey) - 1 AS n_train, nth AS fold FROM g"""
)
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one trial out: each fold with what it holds out and how much it trains on."""
    w = Window.partitionBy("o_custkey")
    return read(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("trial_"), F.col("o_orderkey").cast("string")).alias("held_out"), (F.count(F.lit(1)).over(w) - 1).alias("n_train"), F.row_number().over(w.orderBy(*ORDERED)).cast("long").alias("fold"))


W_SQL = f"w AS (SELECT DISTINCT user_id, us // {STEP} * {STEP} AS s FROM e WHERE event_type <> 'error')"


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).where("event_type <> 'error'").select("user_id", (F.expr(f"us div {STEP}") * STEP).alias("start_us")).distinct().withColumn("end_us", F.col("start_us") + WIDTH)


UNION_SQL = """i AS (SELECT *, max(z) OVER (PARTITION BY {key} ORDER BY s, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM {of}), j AS (SELECT *, sum(CASE WHEN upto IS NULL OR s > upto THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY s, z) AS island FROM i), u AS (SELECT {key}, sum(x) AS covered FROM (SELECT {key}, island, max(z) - min(s) AS x FROM j GROUP BY ALL) GROUP BY ALL)"""


@query(
    f"""WITH {E_SQL}, {W_SQL}, a AS (SELECT *, s + {WIDTH} AS z FROM w), {UNION_SQL.format(key="user_id", of="a")}, t AS (SELECT user_id, max(us) - min(us) + {WIDTH} AS total FROM e GROUP BY user_id)
SELECT user_id, CAST(coalesce(covered, 0) AS BIGINT) AS accepted_us, round(coalesce(covered, 0) / total, 6) AS coverage FROM t LEFT JOIN u USING (user_id)"""
)
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = iv.covered(_accepted(spark, sf_dir), KEY)
    t = stream(spark, sf_dir).groupBy("user_id").agg((F.max("us") - F.min("us") + WIDTH).alias("total")).join(c, "user_id", "left")
    got = F.coalesce("covered_us", F.lit(0)).cast("long")
    return t.select("user_id", got.alias("accepted_us"), r6(got / F.col("total")).alias("coverage"))


@query(
    f"""WITH {E_SQL}, {W_SQL}, r AS (SELECT event_id, user_id, us - {HOUR} AS a, us + {5 * HOUR} AS b FROM e WHERE event_type = 'purchase'),
o AS (SELECT r.event_id, greatest(s, a) AS s, least(s + {WIDTH}, b) AS z FROM r JOIN w ON w.user_id = r.user_id AND s < b AND s + {WIDTH} > a), {UNION_SQL.format(key="event_id", of="o")}
SELECT event_id, CAST(coalesce(covered, 0) AS BIGINT) AS credit_us, coalesce(covered, 0) >= {3 * HOUR} AS credited FROM r LEFT JOIN u USING (event_id)"""
)
def review_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each review that accepted windows cover, overlaps counted once."""
    r = stream(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", (F.col("us") - HOUR).alias("b_start_us"), (F.col("us") + 5 * HOUR).alias("b_end_us"))
    o = iv.overlaps(_accepted(spark, sf_dir), r, KEY, DAY).select("event_id", F.col("common_start_us").alias("start_us"), F.col("common_end_us").alias("end_us"))
    d = r.join(iv.covered(o, ["event_id"]), "event_id", "left")
    got = F.coalesce("covered_us", F.lit(0)).cast("long")
    return d.select("event_id", got.alias("credit_us"), (got >= 3 * HOUR).alias("credited"))


CLUSTER_SQL = f"""v AS (SELECT user_id, event_id, us, value FROM e WHERE event_type = 'view'),
c AS (SELECT a.user_id, a.value AS centre, count(*) AS members, coalesce(stddev_pop(b.value), 0) AS spread FROM (SELECT DISTINCT user_id, value FROM v) a JOIN v b ON a.user_id = b.user_id AND abs(a.value - b.value) <= 5 GROUP BY ALL),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY members DESC, round(spread, 6), centre) AS rn FROM c) WHERE rn = 1),
m AS (SELECT v.*, abs(v.value - win.centre) <= 5 AS inside FROM v JOIN win USING (user_id)),
rest AS (SELECT user_id, event_id, value FROM m WHERE NOT inside),
ru AS (SELECT user_id, max(n) AS runner_up FROM (SELECT a.user_id, a.value, count(*) AS n FROM (SELECT DISTINCT user_id, value FROM rest) a JOIN rest b ON a.user_id = b.user_id AND abs(a.value - b.value) <= 5 GROUP BY ALL) GROUP BY user_id)"""


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(views with whether they lie in their device's winning cluster, winner and runner-up counts)."""
    v = stream(spark, sf_dir).where("event_type = 'view'").select("user_id", "event_id", "us", "value")
    return st.winning_cluster(v, KEY, "value", 5)


@query(
    f"""WITH {E_SQL}, {CLUSTER_SQL}
SELECT win.user_id, centre, members, coalesce(runner_up, 0) AS runner_up, (SELECT count(*) FROM v WHERE v.user_id = win.user_id) AS n FROM win LEFT JOIN ru ON ru.user_id = win.user_id"""
)
def winning_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centre with most values within 5, of equals the tightest; and the best cluster of what is left."""
    return _clusters(spark, sf_dir)[1].select("user_id", "centre", "members", "runner_up", "n")


@query(
    f"""WITH {E_SQL}, {CLUSTER_SQL},
f AS (SELECT user_id, count(*) AS n, count(*) FILTER (inside) AS w, median(CASE WHEN inside THEN value END) AS mid, nullif(regr_slope(CASE WHEN inside THEN value END, CASE WHEN inside THEN us / {float(DAY)} END), 'NaN'::DOUBLE) AS slope FROM m GROUP BY user_id),
s AS (SELECT f.*, coalesce(runner_up, 0) AS r FROM f LEFT JOIN ru USING (user_id))
SELECT user_id, CASE WHEN n < 3 THEN 'insufficient_clean_data' WHEN w * 20 < n OR w < 1.0 * r THEN 'ambiguous_hr' WHEN abs(coalesce(slope, 0)) > 0.15 THEN 'ambiguous_trend' ELSE 'usable' END AS status,
 round(CASE WHEN n >= 3 AND w * 20 >= n AND w >= 1.0 * r AND abs(coalesce(slope, 0)) <= 0.15 THEN mid END, 6) AS bpm FROM s"""
)
def trial_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial's rate from its windows': enough of them, a winning cluster well ahead of the next, no trend."""
    inside, wins = _clusters(spark, sf_dir)
    of = lambda c: F.when(F.col("inside"), c)
    f = inside.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("inside").alias("w"), median(of(F.col("value"))).alias("mid"), F.regr_slope(of(F.col("value")), of(F.col("us") / float(DAY))).alias("slope"))
    d = f.join(wins.select("user_id", "runner_up"), "user_id")
    flat = F.abs(F.coalesce("slope", F.lit(0.0))) <= 0.15
    status = F.when(F.col("n") < 3, "insufficient_clean_data").when((F.col("w") * 20 < F.col("n")) | (F.col("w") < F.col("runner_up")), "ambiguous_hr").when(~flat, "ambiguous_trend").otherwise("usable")
    return d.withColumn("status", status).select("user_id", "status", F.round(F.when(F.col("status") == "usable", F.col("mid")), 6).alias("bpm"))


@query(
    f"""WITH {PRED_SQL}, k AS (SELECT o_orderpriority, truth, guess, 150.0 AS flat, (guess + 150) / 2 AS mixed FROM p WHERE guess IS NOT NULL),
c AS (SELECT *, guess BETWEEN 30 AND 350 AND abs(mixed - flat) < 90 AS common FROM k)
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (common) AS n_common, round(avg(abs(guess - truth)) FILTER (common), 6) AS mae_ppg, round(avg(abs(mixed - truth)) FILTER (common), 6) AS mae_motion, round(avg(abs(flat - truth)) FILTER (common), 6) AS mae_full,
 round(avg(abs(mixed - truth)) FILTER (common) - avg(abs(guess - truth)) FILTER (common), 6) AS gain FROM c GROUP BY o_orderpriority"""
)
def ablation_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models compared on the windows that all of them accept."""
    k = predictions(spark, sf_dir).where("guess is not null").withColumns({"flat": F.lit(150.0), "mixed": (F.col("guess") + 150) / 2})
    both = F.col("guess").between(30, 350) & (F.abs(F.col("mixed") - F.col("flat")) < 90)
    mae = lambda c: F.avg(F.when(both, F.abs(F.col(c) - F.col("truth"))))
    return k.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(both).alias("n_common"), r6(mae("guess")).alias("mae_ppg"), r6(mae("mixed")).alias("mae_motion"), r6(mae("flat")).alias("mae_full"), r6(mae("mixed") - mae("guess")).alias("gain"))


@query(
    f"""WITH {PRED_SQL}, b AS (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY truth, guess) AS nth, o_custkey, truth, guess FROM p WHERE guess IS NOT NULL),
j AS (SELECT o_custkey, x.truth AS truth, x.guess AS guess_b, (y.guess + y.truth) / 2 AS guess_c, y.nth IS NOT NULL AS matched FROM b x LEFT JOIN (SELECT * FROM b WHERE nth % 5 <> 0) y USING (o_custkey, nth))
SELECT o_custkey % 10 AS bucket, count(*) AS n, round(count(*) FILTER (matched) / count(*), 6) AS retention, round(avg(abs(guess_c - truth)) - avg(abs(guess_b - truth)) FILTER (matched), 6) AS mae_change, round(max(abs(guess_c - truth)) - max(abs(guess_b - truth)) FILTER (matched), 6) AS max_change,
 count(*) FILTER (matched) / count(*) >= 0.75 AND avg(abs(guess_c - truth)) - avg(abs(guess_b - truth)) FILTER (matched) <= 2 AND max(abs(guess_c - truth)) - max(abs(guess_b - truth)) FILTER (matched) <= 5 AS accepted FROM j GROUP BY bucket"""
)
def matched_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate policy against the baseline on the occasions that both have: retention, mean and largest error."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("truth", "guess"))
    b = predictions(spark, sf_dir).where("guess is not null").select("o_custkey", "truth", "guess", nth.alias("nth"))
    c = b.where("nth % 5 <> 0").select("o_custkey", "nth", ((F.col("guess") + F.col("truth")) / 2).alias("guess_c"))
    j = b.join(c, ["o_custkey", "nth"], "left")
    err_b, err_c = F.when(F.col("guess_c").isNotNull(), F.abs(F.col("guess") - F.col("truth"))), F.abs(F.col("guess_c") - F.col("truth"))
    kept, mae, worst = F.count("guess_c") / F.count("*"), F.avg(err_c) - F.avg(err_b), F.max(err_c) - F.max(err_b)
    g = j.groupBy((F.col("o_custkey") % 10).alias("bucket")).agg(F.count("*").alias("n"), kept.alias("kept"), mae.alias("mae"), worst.alias("worst"))
    return g.select("bucket", "n", r6("kept").alias("retention"), r6("mae").alias("mae_change"), r6("worst").alias("max_change"), ((F.col("kept") >= 0.75) & (F.col("mae") <= 2) & (F.col("worst") <= 5)).alias("accepted"))


@query(
    f"""WITH {E_SQL}, t AS (SELECT user_id, us // {DAY} AS trial, avg(value) AS mean, median(value) AS mid, max(k) AS cuff, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, count(*) AS trials, CAST(sum(n) AS BIGINT) AS samples, round(avg(mean), 6) AS mean_of_means, round(avg(abs(mid - cuff)), 6) AS mae_cuff, round(max(abs(mid - cuff)), 6) AS worst_cuff, count(*) FILTER (abs(mid - cuff) <= 100) AS within_limit FROM t GROUP BY user_id"""
)
def live_rate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rates of each trial, then over trials, against a cuff."""
    t = stream(spark, sf_dir).groupBy("user_id", F.expr(f"us div {DAY}").alias("trial")).agg(F.avg("value").alias("mean"), median("value").alias("mid"), F.max("k").alias("cuff"), F.count("*").alias("n"))
    off = F.abs(F.col("mid") - F.col("cuff"))
    return t.groupBy("user_id").agg(F.count("*").alias("trials"), F.sum("n").alias("samples"), r6(F.avg("mean")).alias("mean_of_means"), r6(F.avg(off)).alias("mae_cuff"), r6(F.max(off)).alias("worst_cuff"), F.count_if(off <= 100).alias("within_limit"))


@query(
    f"""WITH {PRED_SQL}, g AS (SELECT o_custkey % 8 AS participant, CAST(sum(CAST(round(truth * 1000) AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM p WHERE guess IS NOT NULL GROUP BY ALL),
x AS (SELECT unnest(generate_series(1, 7)) AS size), r AS (SELECT unnest(generate_series(0, 7)) AS start),
t AS (SELECT size, start, sum(s) / 1000.0 / sum(n) AS mean FROM x, r, g WHERE (participant - start + 8) % 8 < size GROUP BY ALL)
SELECT size, count(*) AS draws, round(avg(abs(mean - other)), 6) AS mae FROM (SELECT t.*, h.s / 1000.0 / h.n AS other FROM t JOIN g h ON h.participant = (start + size) % 8) GROUP BY size"""
)
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of a mean over rotating subsets of participants, by the subset's size, on the participant behind it."""
    p = predictions(spark, sf_dir).where("guess is not null")
    g = p.groupBy((F.col("o_custkey") % 8).alias("participant")).agg(F.sum(F.round(F.col("truth") * 1000).cast("long")).alias("s"), F.count("*").alias("n"))
    # each participant is in the subsets of a size that start at it or up to size - 1 before it
    sizes = g.withColumn("size", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long")))).withColumn("back", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    t = sizes.groupBy("size", F.pmod(F.col("participant") - F.col("back"), F.lit(8)).alias("start")).agg((F.sum("s") / 1000.0 / F.sum("n")).alias("mean"))
    h = g.select(F.col("participant").alias("behind"), (F.col("s") / 1000.0 / F.col("n")).alias("other"))
    d = t.withColumn("behind", (F.col("start") + F.col("size")) % 8).join(h, "behind")
    return d.groupBy("size").agg(F.count("*").alias("draws"), r6(F.avg(F.abs(F.col("mean") - F.col("other")))).alias("mae"))


@query(
    """WITH f AS (SELECT l_shipdate, unnest([struct_pack(name := 'quantity', v := l_quantity / 50), struct_pack(name := 'discount', v := l_discount * 10), struct_pack(name := 'tax', v := l_tax * 10), struct_pack(name := 'price', v := l_extendedprice / 100000)]) AS x FROM lineitem),
i AS (SELECT x.name AS name, round(avg(x.v), 3) AS importance FROM f GROUP BY ALL) SELECT name, importance, row_number() OVER (ORDER BY importance DESC, name) AS place FROM i"""
)
def importance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by importance, then name."""
    cols = {"quantity": F.col("l_quantity") / 50, "discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 10, "price": F.col("l_extendedprice") / 100000}
    one = read(spark, sf_dir, "lineitem").agg(*[F.round(F.avg(c), 3).alias(n) for n, c in cols.items()])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("importance")) for n in cols])).alias("x")).select("x.*")
    return long.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "name")).cast("long"))  # a row a feature


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.02 THEN 1 ELSE 0 END AS band_stationary, CASE WHEN l_discount >= 0.02 AND l_discount < 0.08 THEN 1 ELSE 0 END AS band_mild, CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END AS band_severe FROM lineitem"
)
def one_hot_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = band(F.col("l_discount"), [0.02, 0.08], ["stationary", "mild", "severe"])
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[(b == n).cast("int").alias(f"band_{n}") for n in ("stationary", "mild", "severe")])


@query(
    f"""WITH {E_SQL}, t AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS still, count(*) FILTER (event_type = 'view' AND value < 300) AS still_ok, count(*) FILTER (event_type = 'error') AS moving, count(*) FILTER (event_type = 'error' AND value >= 20) AS moving_ok FROM e GROUP BY user_id)
SELECT user_id, round(still_ok / nullif(still, 0), 6) AS still_share, round(moving_ok / nullif(moving, 0), 6) AS moving_share, coalesce(still_ok / nullif(still, 0) >= 0.95 AND moving_ok / nullif(moving, 0) >= 0.9, FALSE) AS accepted FROM t"""
)
def acceptance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    t = stream(spark, sf_dir).groupBy("user_id").agg(F.count_if(e == "view").alias("a"), F.count_if((e == "view") & (F.col("value") < 300)).alias("b"), F.count_if(e == "error").alias("c"), F.count_if((e == "error") & (F.col("value") >= 20)).alias("d"))
    still, moving = ratio(F.col("b"), F.col("a")), ratio(F.col("d"), F.col("c"))
    return t.select("user_id", r6(still).alias("still_share"), r6(moving).alias("moving_share"), F.coalesce((still >= 0.95) & (moving >= 0.9), F.lit(False)).alias("accepted"))


@query(
    f"""WITH {E_SQL}, d AS (SELECT user_id, us - lag(us) OVER ({E_WIN}) AS dt FROM e), g AS (SELECT user_id, count(*) FILTER (dt > {GAP}) AS gaps, count(*) FILTER (dt > {4 * GAP}) AS long_gaps, count(*) AS n FROM d GROUP BY user_id)
SELECT user_id, gaps = 0 AS strict_usable, long_gaps <= 0.2 * n AS tolerant_usable, gaps > 0 AND long_gaps <= 0.2 * n AS changed_to_usable FROM g"""
)
def policy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same recordings under a strict and a gap-tolerant rule."""
    d = se.with_deltas(stream(spark, sf_dir), KEY, "us", "event_id")
    g = d.groupBy("user_id").agg(F.count_if(F.col("dt") > GAP).alias("gaps"), F.count_if(F.col("dt") > 4 * GAP).alias("long"), F.count("*").alias("n"))
    strict, tolerant = F.col("gaps") == 0, F.col("long") <= F.lit(0.2) * F.col("n")
    return g.select("user_id", strict.alias("strict_usable"), tolerant.alias("tolerant_usable"), (~strict & tolerant).alias("changed_to_usable"))


@query(
    f"""WITH {PRED_SQL}, m AS (SELECT o_orderpriority, unnest([struct_pack(model := 'zero_change', e := abs(150 - truth)), struct_pack(model := 'carry', e := abs(guess - truth)), struct_pack(model := 'half', e := abs((guess + 150) / 2 - truth))]) AS x FROM p WHERE guess IS NOT NULL),
s AS (SELECT o_orderpriority, x.model AS model, avg(x.e) AS mae, max(x.e) AS worst FROM m GROUP BY ALL), z AS (SELECT *, max(CASE WHEN model = 'zero_change' THEN mae END) OVER (PARTITION BY o_orderpriority) AS zero FROM s)
SELECT o_orderpriority, model, round(mae, 6) AS mae, round(worst, 6) AS max_abs_error, model <> 'zero_change' AND mae < zero AS beats_zero_change, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(mae, 6), model) AS place FROM z"""
)
def model_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's errors, whether it beats leaving the value as it was, and its place."""
    p = predictions(spark, sf_dir).where("guess is not null")
    models = {"zero_change": F.lit(150.0), "carry": F.col("guess"), "half": (F.col("guess") + 150) / 2}
    m = p.select("o_orderpriority", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.abs(v - F.col("truth")).alias("e")) for k, v in models.items()])).alias("x"))
    s = m.groupBy("o_orderpriority", F.col("x.model").alias("model")).agg(F.avg("x.e").alias("mae"), F.max("x.e").alias("worst"))
    w = Window.partitionBy("o_orderpriority")
    zero = F.max(F.when(F.col("model") == "zero_change", F.col("mae"))).over(w)
    return s.select("o_orderpriority", "model", r6("mae").alias("mae"), r6("worst").alias("max_abs_error"), ((F.col("model") != "zero_change") & (F.col("mae") < zero)).alias("beats_zero_change"), F.row_number().over(w.orderBy(r6("mae"), "model")).cast("long").alias("place"))


@query(
    f"""WITH {E_SQL}, d AS (SELECT *, us - lag(us) OVER ({E_WIN}) AS dt FROM e) SELECT event_id, round(quantile_cont(dt, 0.5) OVER ({E_WIN} ROWS BETWEEN 100 PRECEDING AND CURRENT ROW), 6) AS period_us FROM d"""
)
def running_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median step of the last 101 rows."""
    d = se.with_deltas(stream(spark, sf_dir), KEY, "us", "event_id")
    return d.select("event_id", r6(median("dt").over(se.in_order(KEY, "us", "event_id").rowsBetween(-100, 0))).alias("period_us"))


@query(
    f"""WITH {E_SQL}, m AS (SELECT user_id, max(us) AS last_us FROM e GROUP BY user_id), x AS (SELECT user_id, max(us) AS accepted_us FROM e WHERE event_type = 'view' GROUP BY user_id)
SELECT user_id, accepted_us, coalesce(last_us - accepted_us <= {15 * HOUR}, FALSE) AS fresh FROM m LEFT JOIN x USING (user_id)"""
)
def recent_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last accepted window ends close enough to the last sample."""
    g = stream(spark, sf_dir).groupBy("user_id").agg(F.max("us").alias("last_us"), F.max(F.when(F.col("event_type") == "view", F.col("us"))).alias("accepted_us"))
    return g.select("user_id", "accepted_us", F.coalesce(F.col("last_us") - F.col("accepted_us") <= 15 * HOUR, F.lit(False)).alias("fresh"))


@query(
    f"""WITH {E_SQL}, r AS (SELECT user_id, us // {DAY} AS day, event_type, k % 5 AS status, min(event_id) AS event_id FROM e GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, event_id DESC) AS rn FROM r)
SELECT user_id, event_id, day, event_type, status FROM n WHERE rn <= 20"""
)
def history_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A display's history: an entry once, the last twenty of a device."""
    r = stream(spark, sf_dir).groupBy("user_id", F.expr(f"us div {DAY}").alias("day"), "event_type", (F.col("k") % 5).alias("status")).agg(F.min("event_id").alias("event_id"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day"), F.desc("event_id")))
    return r.withColumn("rn", rn).where("rn <= 20").select("user_id", "event_id", "day", "event_type", "status")


@query(
    f"""WITH {E_SQL}, d AS (SELECT *, us - lag(us) OVER ({E_WIN}) AS dt FROM e), s AS (SELECT *, sum(CASE WHEN dt > {4 * GAP} THEN 1 ELSE 0 END) OVER ({E_WIN}) AS session FROM d),
b AS (SELECT event_id, user_id, session, us, us - min(us) OVER (PARTITION BY user_id, session) AS age, count(*) OVER (PARTITION BY user_id, session ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS buffered FROM s),
g AS (SELECT *, age // {DAY} AS tick FROM b)
SELECT event_id, buffered, age >= {DAY} AND row_number() OVER (PARTITION BY user_id, session, tick ORDER BY us, event_id) = 1 AS analysed FROM g"""
)
def periodic_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded buffer in event time, cleared at gaps, and the rows at which an analysis is due: once a period, when it is full."""
    s = se.with_sessions(stream(spark, sf_dir), KEY, "us", "event_id", 4 * GAP)
    key = ["user_id", "session"]
    age = F.col("us") - F.min("us").over(Window.partitionBy(*key))
    b = s.withColumns({"age": age, "buffered": F.count(F.lit(1)).over(Window.partitionBy(*key).orderBy("us").rangeBetween(-DAY, 0))})
    first = F.row_number().over(Window.partitionBy(*key, F.floor(F.col("age") / DAY)).orderBy("us", "event_id")) == 1
    return b.select("event_id", "buffered", ((F.col("age") >= DAY) & first).alias("analysed"))


@query(
    f"""WITH {E_SQL}, m AS (SELECT event_id, user_id, us, CASE WHEN event_type = 'error' THEN 'moving' WHEN k % 7 = 0 THEN 'calibrating' ELSE 'still' END AS status, k FROM e),
p AS (SELECT *, lag(status) OVER ({E_WIN}) AS prev, lag(k) OVER ({E_WIN}) AS pk FROM m),
r AS (SELECT *, CASE WHEN status = 'moving' AND coalesce(prev, '') <> 'moving' THEN 'motion_detected' WHEN status = 'still' AND prev <> 'still' THEN 'warming_up' WHEN status = 'calibrating' AND coalesce(prev, '') <> 'calibrating' THEN 'calibrating' WHEN k > pk + 60 THEN 'invalid_timing' END AS reset FROM p)
SELECT event_id, reset, CAST(sum(CASE WHEN reset IS NOT NULL THEN 1 ELSE 0 END) OVER ({E_WIN}) AS BIGINT) AS generation FROM r"""
)
def session_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clears a device's buffer: a change of motion status, or a health counter that jumps; and the generation since."""
    w = se.in_order(KEY, "us", "event_id")
    status = F.when(F.col("event_type") == "error", "moving").when(F.col("k") % 7 == 0, "calibrating").otherwise("still")
    p = stream(spark, sf_dir).withColumn("status", status).withColumns({"prev": F.lag("status").over(w), "pk": F.lag("k").over(w)})
    return p.withColumn("reset", st.reset_reason(F.col("status"), F.col("prev"), F.col("k") > F.col("pk") + 60)).select("event_id", "reset", F.sum(F.when(F.col("reset").isNotNull(), 1).otherwise(0)).over(w).alias("generation"))


@query(
    f"""WITH {E_SQL}, r AS (SELECT event_id, user_id, us, sqrt(avg(value * value) OVER ({E_WIN} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS rms FROM e),
m AS (SELECT *, avg(rms) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {WIDTH} PRECEDING AND CURRENT ROW) AS mean, us - min(us) OVER (PARTITION BY user_id) AS age FROM r)
SELECT event_id, CASE WHEN age < {WIDTH} THEN 'unknown' WHEN mean < 40 THEN 'stationary' WHEN mean < 60 THEN 'mild' ELSE 'severe' END AS intensity FROM m"""
)
def live_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of the mean rolling RMS over a window of time, unknown until one has passed."""
    d = se.rolling(stream(spark, sf_dir), KEY, "us", "event_id", 9, 0, rms=F.avg(F.col("value") * F.col("value"))).withColumn("rms", F.sqrt("rms"))
    mean = F.avg("rms").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-WIDTH, 0))
    age = F.col("us") - F.min("us").over(Window.partitionBy("user_id"))
    return d.select("event_id", F.when(age < WIDTH, "unknown").otherwise(band(mean, [40, 60], ["stationary", "mild", "severe"])).alias("intensity"))


@query(
    f"""WITH {E_SQL}, n AS (SELECT *, max(us) OVER (PARTITION BY user_id) AS now FROM e), b AS (SELECT user_id, count(*) FILTER (event_type = 'view' AND us > now - {10 * DAY}) AS ppg, count(*) FILTER (event_type = 'click' AND us > now - {10 * DAY}) AS imu, count(*) FILTER (event_type = 'error' AND us > now - {DAY}) AS faults, max(now) - max(us) FILTER (event_type IN ('view', 'click')) AS quiet FROM n GROUP BY user_id)
SELECT user_id, CASE WHEN faults > 0 THEN 'fault' WHEN ppg < 2 OR imu < 2 THEN 'collecting' WHEN quiet > {2 * DAY} THEN 'stale' ELSE 'ready' END AS readiness FROM b"""
)
def precheck_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both streams of a device fill their buffers, without a fault and without being old."""
    n = stream(spark, sf_dir).withColumn("now", F.max("us").over(Window.partitionBy("user_id")))
    e, recent = F.col("event_type"), F.col("us") > F.col("now") - 10 * DAY
    b = n.groupBy("user_id").agg(F.count_if((e == "view") & recent).alias("ppg"), F.count_if((e == "click") & recent).alias("imu"), F.count_if((e == "error") & (F.col("us") > F.col("now") - DAY)).alias("faults"), (F.max("now") - F.max(F.when(e.isin("view", "click"), F.col("us")))).alias("quiet"))
    ready = F.when(F.col("faults") > 0, "fault").when((F.col("ppg") < 2) | (F.col("imu") < 2), "collecting").when(F.col("quiet") > 2 * DAY, "stale").otherwise("ready")
    return b.select("user_id", ready.alias("readiness"))


@query(
    f"""WITH {E_SQL}, d AS (SELECT user_id, min(us) AS a, max(us) AS z FROM e GROUP BY user_id), g AS (SELECT user_id, unnest(list_distinct(list_append(generate_series(a + {DAY}, z, {DAY}), z))) AS at_us FROM d)
SELECT g.user_id, at_us, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS shown FROM g JOIN e ON e.user_id = g.user_id AND us > at_us - {DAY} AND us <= at_us GROUP BY ALL"""
)
def causal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an analysis at each tick, and at the end, would have shown from the samples behind it alone."""
    e = stream(spark, sf_dir)
    w = Window.partitionBy("user_id")
    first, last = F.min("us").over(w), F.max("us").over(w)
    d = e.select("user_id", "us", "value", first.alias("a"), last.alias("z"))
    # the ticks that a sample counts for: the next one on the grid, if it is not behind the end, and the end itself
    tick = F.col("a") + F.greatest(F.ceil((F.col("us") - F.col("a")) / DAY), F.lit(1)) * DAY
    ticks = F.array_distinct(F.array_compact(F.array(F.when((tick <= F.col("z")) & (F.col("us") > tick - DAY), tick), F.when(F.col("us") > F.col("z") - DAY, F.col("z")))))
    x = d.select("user_id", "value", F.explode(ticks).alias("at_us"))
    return x.groupBy("user_id", "at_us").agg(F.count("*").alias("n"), r6(median("value")).alias("shown"))


@query(
    """SELECT c_custkey, CASE WHEN count(o_orderkey) > 0 AND count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'paired' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'ppg_only' WHEN count(o_orderkey) > 0 THEN 'imu_only' ELSE 'none' END AS modality, count(o_orderkey) AS n, sha256(CAST(c_custkey AS VARCHAR) || '/' || CAST(count(o_orderkey) AS VARCHAR)) AS digest, count(*) FILTER (o_orderstatus = 'F') >= 5 AS eligible FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def recording_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording with what it has, a digest of it, and whether it can take part."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    d = read(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("f", F.lit(0)).alias("f"))
    modality = F.when((F.col("n") > 0) & (F.col("f") > 0), "paired").when(F.col("f") > 0, "ppg_only").when(F.col("n") > 0, "imu_only").otherwise("none")
    return d.select("c_custkey", modality.alias("modality"), "n", F.sha2(F.concat_ws("/", F.col("c_custkey").cast("string"), F.col("n").cast("string")), 256).alias("digest"), (F.col("f") >= 5).alias("eligible"))


@query(
    f"""WITH {E_SQL}, s AS (SELECT user_id, event_id, us, value, lead(value) OVER ({E_WIN}) AS nv, lead(us) OVER ({E_WIN}) AS nu, CAST(event_id % 512 - 256 AS DOUBLE) AS y, CAST(lead(event_id % 512 - 256) OVER ({E_WIN}) AS DOUBLE) AS ny FROM e)
SELECT event_id, round(sqrt((nv - value) * (nv - value) + (ny - y) * (ny - y)) / ((nu - us) / {float(HOUR)}), 6) AS jerk FROM s WHERE nu > us"""
)
def jerk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change of the axes over the time to the next row."""
    w = se.in_order(KEY, "us", "event_id")
    y = (F.col("event_id") % 512 - 256).cast("double")
    d = stream(spark, sf_dir).withColumn("y", y).withColumns({"nv": F.lead("value").over(w), "nu": F.lead("us").over(w), "ny": F.lead("y").over(w)}).where("nu > us")
    a, b = F.col("nv") - F.col("value"), F.col("ny") - F.col("y")
    return d.select("event_id", r6(F.sqrt(a * a + b * b) / ((F.col("nu") - F.col("us")) / float(HOUR))).alias("jerk"))


@query(
    f"""WITH {E_SQL}, n AS (SELECT *, us - min(us) OVER (PARTITION BY user_id) AS head, max(us) OVER (PARTITION BY user_id) - us AS tail, CAST(event_id % 512 - 256 AS DOUBLE) AS y FROM e),
g AS (SELECT user_id, median(CASE WHEN head < {5 * DAY} THEN value END) AS x0, median(CASE WHEN head < {5 * DAY} THEN y END) AS y0, median(CASE WHEN tail < {5 * DAY} THEN value END) AS x1, median(CASE WHEN tail < {5 * DAY} THEN y END) AS y1 FROM n GROUP BY user_id)
SELECT user_id, round(degrees(acos(greatest(-1, least(1, (x0 * x1 + y0 * y1) / (sqrt(x0 * x0 + y0 * y0) * sqrt(x1 * x1 + y1 * y1)))))), 4) AS turned FROM g"""
)
def orientation_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle between the median directions of a recording's beginning and end."""
    w = Window.partitionBy("user_id")
    n = stream(spark, sf_dir).withColumns({"head": F.col("us") - F.min("us").over(w), "tail": F.max("us").over(w) - F.col("us"), "y": (F.col("event_id") % 512 - 256).cast("double")})
    mid = lambda c, side: median(F.when(F.col(side) < 5 * DAY, F.col(c)))
    g = n.groupBy("user_id").agg(mid("value", "head").alias("x0"), mid("y", "head").alias("y0"), mid("value", "tail").alias("x1"), mid("y", "tail").alias("y1"))
    size = lambda i: F.sqrt(F.col(f"x{i}") * F.col(f"x{i}") + F.col(f"y{i}") * F.col(f"y{i}"))
    cosine = (F.col("x0") * F.col("x1") + F.col("y0") * F.col("y1")) / (size(0) * size(1))
    return g.select("user_id", F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))), 4).alias("turned"))


@query(
    f"""WITH {E_SQL}, d AS (SELECT event_id, user_id, us, us - lag(us) OVER ({E_WIN}) AS dt, k FROM e), c AS (SELECT *, CASE WHEN dt IS NULL OR dt > {GAP} OR k < 1 THEN NULL ELSE greatest(-{HOUR}, least({HOUR}, CAST(floor((dt - {HOUR}) / 16.0) AS BIGINT))) END AS step FROM d WHERE dt IS NULL OR dt >= 0)
SELECT user_id, count(step) AS observed, count(*) - count(step) AS refused, CAST(coalesce(sum(step), 0) AS BIGINT) AS corrected_us, CAST(max(abs(step)) AS BIGINT) AS largest_us FROM c GROUP BY user_id"""
)
def clock_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device clock followed by bounded steps: a sixteenth of the phase, within limits; wild observations are refused."""
    d = se.with_deltas(stream(spark, sf_dir), KEY, "us", "event_id").where("dt is null or dt >= 0")
    phase = F.floor((F.col("dt") - HOUR) / 16)
    step = F.when(F.col("dt").isNotNull() & (F.col("dt") <= GAP) & (F.col("k") >= 1), F.greatest(F.lit(-HOUR), F.least(F.lit(HOUR), phase)))
    return d.withColumn("step", step).groupBy("user_id").agg(F.count("step").alias("observed"), (F.count("*") - F.count("step")).alias("refused"), F.coalesce(F.sum("step"), F.lit(0)).cast("long").alias("corrected_us"), F.max(F.abs("step")).cast("long").alias("largest_us"))


@query(
    f"""WITH {E_SQL}, r AS (SELECT user_id, us // {DAY} AS rec, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, quantile_cont(value, 0.5) AS mid FROM e GROUP BY ALL),
s AS (SELECT *, {sorted_sql("CASE WHEN n < 2 THEN 'too_few_samples' END", "CASE WHEN bad > 0 THEN 'sensor_error' END")} AS why FROM r)
SELECT user_id, rec, why = '' AS accepted, why AS rejection, CASE WHEN why = '' THEN round(mid, 6) END AS feature, count(*) FILTER (why = '') OVER (PARTITION BY user_id) AS accepted_of_user FROM s"""
)
def occasion_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording gives a row: those that fail a rule stay as rejected placeholders without features."""
    g = stream(spark, sf_dir).groupBy("user_id", F.expr(f"us div {DAY}").alias("rec")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), median("value").alias("mid"))
    s = g.withColumn("rejection", reasons(("too_few_samples", F.col("n") < 2), ("sensor_error", F.col("bad") > 0)))
    ok = F.col("rejection") == ""
    return s.select("user_id", "rec", ok.alias("accepted"), "rejection", F.when(ok, r6("mid")).alias("feature"), F.count_if(ok).over(Window.partitionBy("user_id")).alias("accepted_of_user"))


@query(
    """WITH p AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer), e AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, n_name || '-' || CAST(nth AS VARCHAR) AS participant, CASE WHEN nth <= 3 THEN 'calibration' ELSE 'other' END AS role FROM e JOIN p ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""
)
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occasions with participant and role from lookup tables, many to one."""
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    p = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", nth.alias("nth")).join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    e = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey").join(p, "o_custkey")
    return e.select("o_orderkey", F.concat_ws("-", "n_name", F.col("nth").cast("string")).alias("participant"), F.when(F.col("nth") <= 3, "calibration").otherwise("other").alias("role"))


@query(
    f"""WITH w AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + {DAY} AS z, row_number() OVER ({O_WIN}) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
s AS (SELECT *, CASE WHEN nth <= 0.7 * n THEN 'train' ELSE 'test' END AS part FROM w), g AS (SELECT o_custkey, max(z) FILTER (part = 'train') AS train_end, min(a) FILTER (part = 'test') AS test_start FROM s GROUP BY o_custkey)
SELECT count(*) AS participants, count(*) FILTER (train_end >= test_start) AS overlapping, count(*) FILTER (train_end IS NULL OR test_start IS NULL) AS one_sided FROM g"""
)
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any participant's training support reaches into what is tested."""
    w = Window.partitionBy("o_custkey")
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    train = F.row_number().over(w.orderBy(*ORDERED)) <= F.lit(0.7) * F.count(F.lit(1)).over(w)
    s = read(spark, sf_dir, "orders").select("o_custkey", at.alias("a"), train.alias("train"))
    g = s.groupBy("o_custkey").agg(F.max(F.when(F.col("train"), F.col("a") + DAY)).alias("train_end"), F.min(F.when(~F.col("train"), F.col("a"))).alias("test_start"))
    return g.agg(F.count("*").alias("participants"), F.count_if(F.col("train_end") >= F.col("test_start")).alias("overlapping"), F.count_if(F.col("train_end").isNull() | F.col("test_start").isNull()).alias("one_sided"))


@query(
    f"""WITH {E_SQL}, r AS (SELECT user_id, event_id, us, event_type, last_value(CASE WHEN event_type = 'error' THEN us END IGNORE NULLS) OVER ({E_WIN} ROWS UNBOUNDED PRECEDING) AS fault_us FROM e),
f AS (SELECT user_id, fault_us, min(us) AS back_us FROM r WHERE fault_us IS NOT NULL AND event_type = 'view' GROUP BY ALL)
SELECT user_id, count(*) AS recoveries, round(quantile_cont((back_us - fault_us) / {float(HOUR)}, 0.5), 6) AS median_hours, round(max((back_us - fault_us) / {float(HOUR)}), 6) AS longest_hours FROM f GROUP BY user_id"""
)
def recovery_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time from a fault to the first estimate behind it, if no other fault comes first."""
    fault = F.last(F.when(F.col("event_type") == "error", F.col("us")), True).over(se.in_order(KEY, "us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    r = stream(spark, sf_dir).withColumn("fault_us", fault).where("fault_us is not null and event_type = 'view'").groupBy("user_id", "fault_us").agg(((F.min("us") - F.col("fault_us")) / float(HOUR)).alias("hours"))
    return r.groupBy("user_id").agg(F.count("*").alias("recoveries"), r6(median("hours")).alias("median_hours"), r6(F.max("hours")).alias("longest_hours"))


@query(
    f"""WITH {E_SQL}, l AS (SELECT user_id, us, value, max(us) OVER (PARTITION BY user_id) AS now FROM e), t AS (SELECT user_id, min(value) AS least, max(value) - min(value) AS span, count(*) AS n FROM l WHERE us >= now - {DAY} GROUP BY user_id)
SELECT user_id, CASE WHEN least <= 5 THEN 'poor_contact' WHEN span > 200 THEN 'contact_step' END AS veto, n FROM t"""
)
def contact_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the samples at the trailing edge say against an estimate."""
    now = F.max("us").over(Window.partitionBy("user_id"))
    t = stream(spark, sf_dir).withColumn("now", now).where(F.col("us") >= F.col("now") - DAY).groupBy("user_id").agg(F.min("value").alias("least"), (F.max("value") - F.min("value")).alias("span"), F.count("*").alias("n"))
    return t.select("user_id", F.when(F.col("least") <= 5, "poor_contact").when(F.col("span") > 200, "contact_step").alias("veto"), "n")


GAPS_SQL = f"g AS (SELECT user_id, kind, us - dt AS before_us, us AS after_us, dt, us - dt // 2 AS mid, row_number() OVER (PARTITION BY user_id, kind ORDER BY us, event_id) AS nth FROM (SELECT *, CASE WHEN event_type IN ('view', 'purchase') THEN 'ppg' ELSE 'imu' END AS kind, us - lag(us) OVER (PARTITION BY user_id, event_type IN ('view', 'purchase') ORDER BY us, event_id) AS dt FROM e) WHERE dt > {8 * GAP})"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir).withColumn("kind", F.when(F.col("event_type").isin("view", "purchase"), "ppg").otherwise("imu"))
    d = se.gap_events(e, ["user_id", "kind"], "us", "event_id", 8 * GAP)
    return d.withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "kind").orderBy("after_us", "after_id")))


@query(
    f"""WITH {E_SQL}, {GAPS_SQL}, c AS (SELECT user_id, count(*) FILTER (kind = 'ppg') AS p, count(*) FILTER (kind = 'imu') AS i, coalesce(max(dt), 0) AS longest FROM g GROUP BY user_id),
o AS (SELECT a.user_id, max(abs(a.mid - b.mid)) AS off FROM g a JOIN g b ON a.user_id = b.user_id AND a.nth = b.nth AND a.kind = 'ppg' AND b.kind = 'imu' GROUP BY a.user_id)
SELECT user_id, {sorted_sql("CASE WHEN p > 6 THEN 'too_many_ppg_gaps' END", "CASE WHEN i > 6 THEN 'too_many_imu_gaps' END", "CASE WHEN p <> i THEN 'unsynchronized_gap_count' END", f"CASE WHEN longest > {40 * GAP} THEN 'gap_too_long' END", f"CASE WHEN off > {4 * GAP} THEN 'unsynchronized_gap_time' END")} AS reasons FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN c USING (user_id) LEFT JOIN o USING (user_id)"""
)
def gap_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a recording's gaps are few, short, and the same in both streams: the nth of one against the nth of the other."""
    g = _gaps(spark, sf_dir)
    c = g.groupBy("user_id").agg(F.count_if(F.col("kind") == "ppg").alias("p"), F.count_if(F.col("kind") == "imu").alias("i"), F.max("span_us").alias("longest"))
    side = lambda k: g.where(F.col("kind") == k).select("user_id", "nth", F.col("mid_us").alias(k))
    o = side("ppg").join(side("imu"), ["user_id", "nth"]).groupBy("user_id").agg(F.max(F.abs(F.col("ppg") - F.col("imu"))).alias("off"))
    d = stream(spark, sf_dir).select("user_id").distinct().join(c, "user_id", "left").join(o, "user_id", "left")
    why = reasons(("too_many_ppg_gaps", F.col("p") > 6), ("too_many_imu_gaps", F.col("i") > 6), ("unsynchronized_gap_count", F.col("p") != F.col("i")), ("gap_too_long", F.col("longest") > 40 * GAP), ("unsynchronized_gap_time", F.col("off") > 4 * GAP))
    return d.select("user_id", why.alias("reasons"))


@query(
    f"""WITH {E_SQL}, {GAPS_SQL}, s AS (SELECT user_id, min(us) AS a, max(us) AS z FROM e WHERE event_type IN ('view', 'purchase') GROUP BY user_id),
b AS (SELECT user_id, a AS start_us, 0 AS nth FROM s UNION ALL SELECT user_id, after_us + {HOUR}, nth FROM g WHERE kind = 'ppg'),
i AS (SELECT b.user_id, b.start_us, coalesce(g.before_us - {HOUR}, s.z) AS end_us FROM b JOIN s USING (user_id) LEFT JOIN g ON g.user_id = b.user_id AND g.kind = 'ppg' AND g.nth = b.nth + 1)
SELECT i.user_id, i.start_us, i.end_us, count(event_id) AS n, round(quantile_cont(value, 0.5), 6) AS mid FROM i LEFT JOIN e ON e.user_id = i.user_id AND us >= start_us AND us < end_us WHERE end_us > start_us GROUP BY ALL"""
)
def continuous_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between a recording's gaps, with a guard on either side, and the samples of each interval."""
    e = stream(spark, sf_dir)
    s = e.where("event_type in ('view', 'purchase')").groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("z"))
    g = _gaps(spark, sf_dir).where("kind = 'ppg'")
    starts = s.select("user_id", F.col("a").alias("start_us")).unionByName(g.select("user_id", (F.col("after_us") + HOUR).alias("start_us")))
    ends = s.select("user_id", F.col("z").alias("end_us")).unionByName(g.select("user_id", (F.col("before_us") - HOUR).alias("end_us")))
    # the nth start belongs to the nth end: both rise together
    numbered = lambda d, c: d.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(c)))
    i = numbered(starts, "start_us").join(numbered(ends, "end_us"), ["user_id", "nth"]).where("end_us > start_us").drop("nth")
    # intervals are apart, so each sample has at most one: the latest that begins before it
    got = iv.asof(e, i.withColumns({"us": F.col("start_us"), "event_id": F.lit(-1).cast("long")}), KEY, "us", "event_id", ["start_us", "end_us"]).where("us < asof_end_us")
    m = got.groupBy("user_id", F.col("asof_start_us").alias("start_us")).agg(F.count("*").alias("n"), r6(median("value")).alias("mid"))
    return i.join(m, ["user_id", "start_us"], "left").select("user_id", "start_us", "end_us", F.coalesce("n", F.lit(0)).alias("n"), "mid")


@query(
    f"""WITH {E_SQL}, d AS (SELECT user_id, us // {DAY} AS trial, us, value, event_type, us - lag(us) OVER ({E_WIN}) AS dt FROM e),
c AS (SELECT user_id, trial, count(*) AS n, round(quantile_cont(dt, 0.5), 6) AS period, round(avg(value), 6) AS computed, count(*) FILTER (event_type = 'error') AS faults FROM d GROUP BY ALL),
m AS (SELECT DISTINCT user_id, us // {DAY} AS trial, CASE WHEN (us // {DAY}) % 3 = 0 THEN 77.0 END AS stated FROM e UNION SELECT DISTINCT user_id, -1, 50.0 FROM e)
SELECT user_id, trial, coalesce(n, 0) AS n, period, coalesce(stated, computed) AS rate, CASE WHEN n IS NULL THEN 'reject' WHEN faults > 0 THEN 'invalid_timing' WHEN n < 2 THEN 'borderline' ELSE 'usable' END AS status FROM m LEFT JOIN c USING (user_id, trial)"""
)
def trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every trial that metadata know: stated values before computed ones, health before quality, and missing files as rejects."""
    trial = F.expr(f"us div {DAY}").alias("trial")
    d = se.with_deltas(stream(spark, sf_dir), KEY, "us", "event_id")
    c = d.groupBy("user_id", trial).agg(F.count("*").alias("n"), r6(median("dt")).alias("period"), r6(F.avg("value")).alias("computed"), F.count_if(F.col("event_type") == "error").alias("faults"))
    known = stream(spark, sf_dir).select("user_id", trial).distinct().withColumn("stated", F.when(F.col("trial") % 3 == 0, 77.0))
    known = known.unionByName(known.select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("trial"), F.lit(50.0).alias("stated")))
    status = F.when(F.col("n").isNull(), "reject").when(F.col("faults") > 0, "invalid_timing").when(F.col("n") < 2, "borderline").otherwise("usable")
    return known.join(c, ["user_id", "trial"], "left").select("user_id", "trial", F.coalesce("n", F.lit(0)).alias("n"), "period", F.coalesce("stated", "computed").alias("rate"), status.alias("status"))


TYPED_SQL = "CASE WHEN event_type = 'error' THEN 'moving' WHEN value < 10 THEN 'poor_contact' WHEN value > 150 THEN 'contact_step' ELSE 'clean' END"


@query(
    f"""WITH {E_SQL}, t AS (SELECT *, {TYPED_SQL} AS kind FROM e), n AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER ({E_WIN}) THEN 1 ELSE 0 END AS new FROM t), r AS (SELECT *, sum(new) OVER ({E_WIN}) AS run FROM n)
SELECT user_id, CAST(run AS BIGINT) AS run, kind, min(us) AS start_us, max(us) AS end_us, count(*) AS n_rows, CASE WHEN kind = 'clean' THEN 'unreviewed' ELSE 'automatic' END AS review FROM r GROUP BY user_id, run, kind"""
)
def typed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording cut into intervals of one kind each."""
    w = se.in_order(KEY, "us", "event_id")
    v = F.col("value")
    kind = F.when(F.col("event_type") == "error", "moving").when(v < 10, "poor_contact").when(v > 150, "contact_step").otherwise("clean")
    t = stream(spark, sf_dir).withColumn("kind", kind)
    r = t.withColumn("new", F.when(F.col("kind").eqNullSafe(F.lag("kind").over(w)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return r.groupBy("user_id", "run", "kind").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n_rows")).withColumn("review", F.when(F.col("kind") == "clean", "unreviewed").otherwise("automatic"))


@query(
    f"""WITH {E_SQL}, w AS (SELECT user_id, event_id, us, k, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS back FROM e WHERE event_type = 'error'), l AS (SELECT user_id, event_type, k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, event_id DESC) AS back FROM e)
SELECT u.user_id, (SELECT k FROM l WHERE l.user_id = u.user_id AND event_type = 'view' AND back = 1) AS latest_view, (SELECT k FROM l WHERE l.user_id = u.user_id AND event_type = 'click' AND back = 1) AS latest_click,
 (SELECT count(*) FROM w WHERE w.user_id = u.user_id) AS warnings, (SELECT string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY back) FROM w WHERE w.user_id = u.user_id AND back <= 3) AS last_warnings FROM (SELECT DISTINCT user_id FROM e) u"""
)
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device's latest record of each kind, how many warnings it gave, and the last three."""
    e, t = stream(spark, sf_dir), F.col("event_type")
    at = F.struct("us", "event_id")
    latest = lambda kind: F.max_by(F.when(t == kind, F.col("k")), F.when(t == kind, at)).alias(f"latest_{kind}")
    g = e.groupBy("user_id").agg(latest("view"), latest("click"), F.count_if(t == "error").alias("warnings"))
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id")))
    last = e.where(t == "error").withColumn("back", back).where("back <= 3").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("back", "event_id"))).alias("l"))  # three rows
    last = last.select("user_id", F.array_join(F.transform("l", lambda x: x["event_id"].cast("string")), ";").alias("last_warnings"))
    return g.join(last, "user_id", "left")


@query(
    """WITH s AS (SELECT d.doc_id, d.source, l.quality AS truth, CAST(d.n_chars >= 500 AS INTEGER) AS guess, d.doc_id % 7 = 0 AS trained_on FROM documents d JOIN labels l USING (doc_id))
SELECT source, count(*) FILTER (trained_on) AS refused, count(*) FILTER (NOT trained_on) AS n, count(*) FILTER (NOT trained_on AND truth = 1 AND guess = 1) AS tp, count(*) FILTER (NOT trained_on AND truth = 0 AND guess = 0) AS tn,
 round((count(*) FILTER (NOT trained_on AND truth = 1 AND guess = 1) / nullif(count(*) FILTER (NOT trained_on AND truth = 1), 0) + count(*) FILTER (NOT trained_on AND truth = 0 AND guess = 0) / nullif(count(*) FILTER (NOT trained_on AND truth = 0), 0)) / 2, 6) AS balanced_accuracy FROM s GROUP BY source"""
)
def frozen_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed classifier on trials that it was not fitted to; those it knows are counted and left out."""
    s = read(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") >= 500).cast("int").alias("guess")).join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth")), "doc_id")
    fresh = F.col("doc_id") % 7 != 0
    c = st.confusion(F.when(fresh, F.col("truth")), F.col("guess"))
    return s.groupBy("source").agg(F.count_if(~fresh).alias("refused"), F.count_if(fresh).alias("n"), c["tp"].alias("tp"), c["tn"].alias("tn"), r6(c["balanced_accuracy"]).alias("balanced_accuracy"))


@query(
    f"""WITH o AS (SELECT o_custkey, o_orderpriority, o_totalprice / 1000 AS truth, avg(o_totalprice / 1000) OVER ({O_WIN} ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS g1, avg(o_totalprice / 1000) OVER ({O_WIN} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS g2, avg(o_totalprice / 1000) OVER ({O_WIN} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS g4, row_number() OVER ({O_WIN}) AS nth FROM orders),
l AS (SELECT unnest([1, 2, 4]) AS duration, * FROM o WHERE nth > 4)
SELECT duration, count(*) AS n, round(avg(abs(CASE duration WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE g4 END - truth)), 6) AS mae, count(DISTINCT o_custkey) AS participants FROM l GROUP BY duration"""
)
def duration_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same estimate from shorter and longer histories, on the occasions that have the longest."""
    w = se.in_order(["o_custkey"], *ORDERED)
    v = F.col("o_totalprice") / 1000
    o = read(spark, sf_dir, "orders").select("o_custkey", v.alias("truth"), F.row_number().over(w).alias("nth"), *[F.avg(v).over(w.rowsBetween(-d, -1)).alias(f"g{d}") for d in (1, 2, 4)]).where("nth > 4")
    long = o.select("o_custkey", "truth", F.explode(F.array(*[F.struct(F.lit(d).alias("duration"), F.col(f"g{d}").alias("g")) for d in (1, 2, 4)])).alias("x"))
    return long.groupBy(F.col("x.duration").alias("duration")).agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("x.g") - F.col("truth")))).alias("mae"), F.countDistinct("o_custkey").alias("participants"))


@query(
    f"""WITH {E_SQL}, l AS (SELECT *, max(us) OVER (PARTITION BY user_id) AS z FROM e), x AS (SELECT unnest([2, 5, 10]) AS days, * FROM l)
SELECT user_id, days, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS mid, round(CASE WHEN count(DISTINCT us) > 1 THEN regr_slope(value, (us - z) / {float(DAY)}) END, 6) AS slope FROM x WHERE us > z - days * {DAY} GROUP BY ALL"""
)
def observation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of windows of several lengths that end with the recording."""
    z = F.max("us").over(Window.partitionBy("user_id"))
    x = stream(spark, sf_dir).withColumn("z", z).where(F.col("us") > F.col("z") - 10 * DAY).withColumn("days", F.explode(F.array(F.lit(2), F.lit(5), F.lit(10)))).where(F.col("us") > F.col("z") - F.col("days").cast("long") * DAY)
    slope = F.when(F.countDistinct("us") > 1, F.regr_slope(F.col("value"), (F.col("us") - F.col("z")) / float(DAY)))
    return x.groupBy("user_id", "days").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(median("value")).alias("mid"), r6(slope).alias("slope"))


@query(
    f"""WITH {E_SQL}, p AS (SELECT user_id, event_id, us, value FROM e WHERE event_type = 'purchase'), w AS (SELECT DISTINCT user_id, us // {STEP} * {STEP} AS s FROM e WHERE event_type <> 'error')
SELECT w.user_id, s AS start_us, count(event_id) AS references, round(avg(value), 6) AS reference FROM w JOIN p ON p.user_id = w.user_id AND s >= us - {DAY} AND s + {WIDTH} <= us + {DAY} GROUP BY ALL"""
)
def referenced_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that lie wholly in the support of a reference, found by buckets of time."""
    p = stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "event_id", "value", (F.col("us") - DAY).alias("b_start_us"), (F.col("us") + DAY).alias("b_end_us"))
    o = iv.overlaps(_accepted(spark, sf_dir), p, KEY, DAY).where("start_us >= b_start_us and end_us <= b_end_us")
    return o.groupBy("user_id", "start_us").agg(F.count("event_id").alias("references"), r6(F.avg("value")).alias("reference"))


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, o_orderkey AS package, o_totalprice >= 100000 AS gate_passed, o_orderpriority || '/' || CAST(o_custkey AS VARCHAR) AS identity FROM r WHERE back = 1"""
)
def model_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest package of each participant with its gate."""
    back = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    r = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumn("back", back).where("back = 1")
    return r.select("o_custkey", F.col("o_orderkey").alias("package"), (F.col("o_totalprice") >= 100000).alias("gate_passed"), F.concat_ws("/", "o_orderpriority", F.col("o_custkey").cast("string")).alias("identity"))


@query(
    f"""WITH {E_SQL}, i AS (SELECT *, CAST(user_id AS VARCHAR) || '|' || CAST(us // {10 * DAY} AS VARCHAR) || '|' || CASE WHEN k > 50 THEN 'a' ELSE 'b' END AS identity FROM e), c AS (SELECT *, CASE WHEN identity <> lag(identity) OVER ({E_WIN}) THEN 1 ELSE 0 END AS changed FROM i), g AS (SELECT *, sum(changed) OVER ({E_WIN}) AS gen FROM c)
SELECT event_id, identity, changed = 1 AS cleared, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, gen ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS held FROM g"""
)
def held_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last estimate, held only as long as participant, calibration and model stay the same."""
    w = se.in_order(KEY, "us", "event_id")
    identity = F.concat_ws("|", F.col("user_id").cast("string"), F.expr(f"us div {10 * DAY}").cast("string"), F.when(F.col("k") > 50, "a").otherwise("b"))
    c = stream(spark, sf_dir).withColumn("identity", identity).withColumn("changed", F.coalesce(F.col("identity") != F.lag("identity").over(w), F.lit(False)))
    g = c.withColumn("gen", F.sum(F.col("changed").cast("int")).over(w))
    held = F.last(F.when(F.col("event_type") == "view", F.col("value")), True).over(se.in_order([*KEY, "gen"], "us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return g.select("event_id", "identity", F.col("changed").alias("cleared"), held.alias("held"))


@query(
    """WITH b AS (SELECT c_custkey, c_acctbal, c_mktsegment, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS band FROM customer), q AS (SELECT c_mktsegment, quantile_disc(abs(c_acctbal - 4500), 0.9) AS width FROM b WHERE c_custkey % 2 = 0 GROUP BY c_mktsegment)
SELECT b.c_mktsegment, band, count(*) AS n, count(*) FILTER (abs(c_acctbal - 4500) <= width) AS covered, round(avg(abs(c_acctbal - 4500)) FILTER (width <= 4900), 6) AS mae_accepted FROM b JOIN q USING (c_mktsegment) WHERE c_custkey % 2 = 1 GROUP BY b.c_mktsegment, band"""
)
def conformal_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half widths from one half of the participants, coverage on the other; only narrow strata are accepted."""
    band_of = F.ntile(4).over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey"))
    b = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.abs(F.col("c_acctbal") - 4500).alias("off"), band_of.alias("band"))
    # the ceil(0.9 n)-th smallest
    n = Window.partitionBy("c_mktsegment")
    half = b.where("c_custkey % 2 = 0").withColumns({"r": F.row_number().over(n.orderBy("off")), "n": F.count(F.lit(1)).over(n)}).where(F.col("r") == F.ceil(F.col("n") * F.lit(9) / 10))
    j = b.where("c_custkey % 2 = 1").join(half.select("c_mktsegment", F.col("off").alias("width")), "c_mktsegment")
    return j.groupBy("c_mktsegment", F.col("band").cast("long").alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("off") <= F.col("width")).alias("covered"), r6(F.avg(F.when(F.col("width") <= 4900, F.col("off")))).alias("mae_accepted"))
