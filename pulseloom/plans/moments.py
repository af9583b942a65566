"""Queries of models from moments, with their closed forms in SQL. orders are occasions, participants are groups of customers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import combined, gram
from ..operators import series as se
from .catalogue import O_WIN, ORDERED, r6, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FEATURES = ["prior", "urgent", "month"]
SETS = {"base": FEATURES[:1], "intensity": FEATURES[:2], "full": FEATURES}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def examples(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    prior = F.lag("o_totalprice").over(se.in_order(["o_custkey"], *ORDERED)) / 1000
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", prior.alias("prior"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"), F.month("o_orderdate").cast("double").alias("month"), (F.col("o_totalprice") / 1000).alias("truth"), *(c.alias(k) for k, c in more.items()))
    return o.where("prior is not null")


X_SQL = f"""o AS (SELECT o_custkey, o_orderkey, o_orderpriority, lag(o_totalprice) OVER ({O_WIN}) / 1000 AS x1, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x2, month(o_orderdate)::DOUBLE AS x3, o_totalprice / 1000 AS t FROM orders),
x AS (SELECT * FROM o WHERE x1 IS NOT NULL)"""
_V = ["x1", "x2", "x3", "t"]
_PAIRS = [(a, b) for i, a in enumerate(_V) for b in _V[i:]]
SUMS_SQL = ", ".join(["count(*)::DOUBLE AS n", *(f"sum({v}) AS {v}" for v in _V), *(f"sum({a} * {b}) AS {a}{b}" for a, b in _PAIRS)])
SUM_NAMES = ["n", *_V, *(a + b for a, b in _PAIRS)]


def solve_sql(of: str, keys: str) -> str:
    """CTEs ending in w: keys, n, means m1 to mt and the weights of the three nested models, from sums of the name of."""
    k = keys + ", "
    return f"""c AS (SELECT {k}n, x1 / n AS m1, x2 / n AS m2, x3 / n AS m3, t / n AS mt, sqrt(x1x1 / n - x1 / n * x1 / n) AS z1, sqrt(x2x2 / n - x2 / n * x2 / n) AS z2, sqrt(x3x3 / n - x3 / n * x3 / n) AS z3,
 x1x2 / n - x1 / n * x2 / n AS c12, x1x3 / n - x1 / n * x3 / n AS c13, x2x3 / n - x2 / n * x3 / n AS c23, x1t / n - x1 / n * t / n AS c1, x2t / n - x2 / n * t / n AS c2, x3t / n - x3 / n * t / n AS c3 FROM {of}),
k AS (SELECT *, n + 1 AS d, c12 / z1 / z2 * n AS k12, c13 / z1 / z3 * n AS k13, c23 / z2 / z3 * n AS k23, c1 / z1 * n AS r1, c2 / z2 * n AS r2, c3 / z3 * n AS r3 FROM c),
det AS (SELECT *, d * d - k12 * k12 AS d2, d * (d * d - k23 * k23) - k12 * (k12 * d - k23 * k13) + k13 * (k12 * k23 - d * k13) AS d3 FROM k),
w AS (SELECT {k}n, m1, m2, m3, mt, r1 / d / z1 AS a1, (r1 * d - k12 * r2) / d2 / z1 AS b1, (d * r2 - k12 * r1) / d2 / z2 AS b2,
 (r1 * (d * d - k23 * k23) - k12 * (r2 * d - k23 * r3) + k13 * (r2 * k23 - d * r3)) / d3 / z1 AS f1, (d * (r2 * d - k23 * r3) - r1 * (k12 * d - k23 * k13) + k13 * (k12 * r3 - r2 * k13)) / d3 / z2 AS f2, (d * (d * r3 - r2 * k23) - k12 * (k12 * r3 - r2 * k13) + r1 * (k12 * k23 - d * k13)) / d3 / z3 AS f3 FROM det)"""


def said_sql(rows: str, on: str) -> str:
    """A CTE y: rows beside each model's word."""
    word = {"base": "mt + a1 * (x1 - m1)", "intensity": "mt + b1 * (x1 - m1) + b2 * (x2 - m2)", "full": "mt + f1 * (x1 - m1) + f2 * (x2 - m2) + f3 * (x3 - m3)"}
    return "y AS (" + " UNION ALL ".join(f"SELECT {rows}.*, '{m}' AS model, w.n AS n_train, {e} AS said FROM {rows} {on}" for m, e in word.items()) + ")"


@query(
    f"""WITH {X_SQL}, q AS (SELECT *, o_custkey % 20 AS who FROM x), g AS (SELECT who, {SUMS_SQL} FROM q GROUP BY who), a AS (SELECT {", ".join(f"sum({s}) AS {s}" for s in SUM_NAMES)} FROM g),
l AS (SELECT g.who, {", ".join(f"a.{s} - g.{s} AS {s}" for s in SUM_NAMES)} FROM g, a WHERE g.who < 16), {solve_sql("l", "who")}, {said_sql("q", "JOIN w USING (who)")}
SELECT who, model, n_train::BIGINT AS n_train, count(*) AS n, round(avg(abs(said - t)), 6) AS mae, round(sqrt(avg((said - t) * (said - t))), 6) AS rmse, round(avg(said - t), 6) AS bias FROM y GROUP BY who, model, n_train"""
)
def ridge_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested feature sets on each participant left out; four participants are auxiliary and always fitted to."""
    x = examples(spark, sf_dir).withColumn("who", F.col("o_custkey") % 20)
    p = gram.predicted(x, gram.left_out(x, "who", FEATURES, ["truth"], SETS, held=F.col("who") < 16), ["who"], FEATURES)
    off = F.col("predicted") - F.col("truth")
    return p.groupBy("who", "model", "n_train").agg(F.count("*").alias("n"), r6(F.avg(F.abs(off))).alias("mae"), r6(F.sqrt(F.avg(off * off))).alias("rmse"), r6(F.avg(off)).alias("bias"))


WIDEST, COVERAGE, LEAST = 330.0, 0.8, 5


@query(
    f"""WITH {X_SQL}, g AS (SELECT {SUMS_SQL} FROM x WHERE o_orderkey % 3 = 0), {solve_sql("g", "1 AS one")}, {said_sql("x", "CROSS JOIN w")},
u AS (SELECT model, o_orderpriority, o_custkey, max(abs(said - t)) AS worst FROM y WHERE o_orderkey % 3 = 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model, o_orderpriority ORDER BY worst, o_custkey) AS place, count(*) OVER (PARTITION BY model, o_orderpriority) AS n FROM u),
h AS (SELECT model, o_orderpriority, CASE WHEN max(n) >= {LEAST} THEN max(CASE WHEN place = ceil((n + 1) * {COVERAGE}) THEN worst END) END AS width FROM r GROUP BY ALL),
s AS (SELECT y.*, coalesce(h.width <= {WIDEST} AND y.o_orderpriority <> '5-LOW' AND said > 0, false) AS accepted, coalesce(abs(said - t) <= h.width, true) AS covered FROM y JOIN h USING (model, o_orderpriority) WHERE o_orderkey % 3 = 2),
b AS (SELECT *, bool_and(accepted) OVER (PARTITION BY o_orderkey) AS common FROM s)
SELECT model, count(*) AS n, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (covered) AS n_covered, count(*) FILTER (common) AS n_common, round(avg(abs(said - t)) FILTER (accepted), 6) AS mae_accepted, round(avg(abs(said - t)) FILTER (common), 6) AS mae_common FROM b GROUP BY model"""
)
def ablation_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sets fitted to one third of the occasions; another gives half widths by severity, the last is judged."""
    x = examples(spark, sf_dir).withColumn("part", F.col("o_orderkey") % 3)
    fit = gram.complete(x.where("part = 0"), [*FEATURES, "truth"])
    centre = gram.means(fit, [*FEATURES, "truth"])
    models = gram.ridge_models(gram.moments(fit, ["part"], [*FEATURES, "truth"], centre), ["part"], FEATURES, ["truth"], SETS, centre)
    y = gram.predicted(x.where("part > 0"), models, [], FEATURES, "said").withColumn("off", F.col("said") - F.col("truth"))
    widths = gram.half_widths(y.where("part = 1"), ["model", "o_orderpriority"], "o_custkey", "off", COVERAGE, LEAST)
    s = y.where("part = 2").join(widths, ["model", "o_orderpriority"])
    s = s.withColumns({"accepted": (F.col("half_width") <= WIDEST) & (F.col("o_orderpriority") != "5-LOW") & (F.col("said") > 0), "covered": F.abs("off") <= F.col("half_width")})
    s = s.withColumn("common", F.min(F.col("accepted").cast("int")).over(Window.partitionBy("o_orderkey")) == 1)
    mae = lambda c: r6(F.avg(F.when(F.col(c), F.abs("off"))))
    return s.groupBy("model").agg(F.count("*").alias("n"), *(F.count_if(F.col(c)).alias(f"n_{c}") for c in ("accepted", "covered", "common")), mae("accepted").alias("mae_accepted"), mae("common").alias("mae_common"))


@query(
    f"""WITH {X_SQL}, q AS (SELECT *, o_custkey % 8 AS who FROM x), g AS (SELECT who, {SUMS_SQL} FROM q GROUP BY who), i AS (SELECT unnest(generate_series(1, 7)) AS size), j AS (SELECT unnest(generate_series(0, 7)) AS start),
l AS (SELECT size, start, {", ".join(f"sum({s}) AS {s}" for s in SUM_NAMES)} FROM g, i, j WHERE (who - start + 8) % 8 < size GROUP BY size, start), {solve_sql("l", "size, start")}, {said_sql("q", "JOIN w ON q.who = (w.start + w.size) % 8").replace("SELECT q.*,", "SELECT q.*, w.size, w.start,")},
d AS (SELECT size, model, start, avg(abs(said - t)) AS mae FROM y GROUP BY ALL)
SELECT size, model, count(*) AS draws, round(avg(mae), 6) AS mae, round(max(mae), 6) AS worst FROM d GROUP BY size, model"""
)
def model_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models fitted to rotating subsets of participants, by the subset's size, on the participant behind it: sums of moments alone."""
    x = examples(spark, sf_dir).withColumn("who", F.col("o_custkey") % 8)
    values = [*FEATURES, "truth"]
    centre = gram.means(x, values)
    sums = gram.moments(x, ["who"], values, centre)
    # a participant is in the subsets of a size that start at it or up to size - 1 before it
    of = sums.withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("back", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    of = of.groupBy(F.col("size").cast("long").alias("size"), F.pmod(F.col("who") - F.col("back"), F.lit(8)).alias("start"))
    width = (len(values) + 1) * (len(values) + 2) // 2
    subsets = of.agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
    models = gram.ridge_models(subsets, ["size", "start"], FEATURES, ["truth"], SETS, centre).withColumn("who", (F.col("start") + F.col("size")) % 8)
    met = gram.predicted(x, models.withColumn("model", F.concat_ws("/", "model", "size", "start")), ["who"], FEATURES)
    part = F.split("model", "/")
    d = met.groupBy(part[1].cast("long").alias("size"), part[0].alias("model"), part[2].alias("start")).agg(F.avg(F.abs(F.col("predicted") - F.col("truth"))).alias("mae"))
    return d.groupBy("size", "model").agg(F.count("*").alias("draws"), r6(F.avg("mae")).alias("mae"), r6(F.max("mae")).alias("worst"))


@query(
    f"""WITH o AS (SELECT o_custkey % 12 AS who, o_totalprice / 1000 AS t, avg(o_totalprice / 1000) OVER ({O_WIN} ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS g1, avg(o_totalprice / 1000) OVER ({O_WIN} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS g2, avg(o_totalprice / 1000) OVER ({O_WIN} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS g4, row_number() OVER ({O_WIN}) AS nth FROM orders),
l AS (SELECT who, t, unnest([1, 2, 4]) AS duration, unnest([g1, g2, g4]) AS x FROM o WHERE nth > 4), g AS (SELECT who, duration, count(*)::DOUBLE AS n, sum(x) AS x, sum(t) AS t, sum(x * x) AS xx, sum(x * t) AS xt FROM l GROUP BY ALL),
a AS (SELECT duration, sum(n) AS n, sum(x) AS x, sum(t) AS t, sum(xx) AS xx, sum(xt) AS xt FROM g GROUP BY duration), r AS (SELECT g.who, duration, a.n - g.n AS n, a.x - g.x AS x, a.t - g.t AS t, a.xx - g.xx AS xx, a.xt - g.xt AS xt FROM g JOIN a USING (duration)),
w AS (SELECT who, duration, x / n AS mx, t / n AS mt, (xt / n - x / n * t / n) / (xx / n - x / n * x / n) * n / (n + 1) AS b FROM r)
SELECT duration::VARCHAR AS duration, count(*) AS n, round(avg(abs(mt + b * (l.x - mx) - l.t)), 6) AS mae, round(avg(mt + b * (l.x - mx) - l.t), 6) AS bias FROM l JOIN w USING (who, duration) GROUP BY duration"""
)
def duration_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge from shorter and longer histories on participants left out, all durations from the same moments."""
    w = se.in_order(["o_custkey"], *ORDERED)
    v = F.col("o_totalprice") / 1000
    durations = (1, 2, 4)
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 12).alias("who"), v.alias("truth"), F.row_number().over(w).alias("nth"), *(F.avg(v).over(w.rowsBetween(-d, -1)).alias(f"g{d}") for d in durations)).where("nth > 4")
    names = [f"g{d}" for d in durations]
    p = gram.predicted(o, gram.left_out(o, "who", names, ["truth"], {str(d): [f"g{d}"] for d in durations}), ["who"], names)
    off = F.col("predicted") - F.col("truth")
    return p.groupBy(F.col("model").alias("duration")).agg(F.count("*").alias("n"), r6(F.avg(F.abs(off))).alias("mae"), r6(F.avg(off)).alias("bias"))


SETUP = combined.Design(setup="setup", target_setup=1, time="us", tie="o_orderkey", features=("prior",), targets=("truth",), setups=(0, 1), alphas=(1.0, 2000.0), splits=3, simpler=True)
LOCKED = 883_612_800_000_000  # from 1998 on
#: Later occasions of the target setup and their folds: three runs of a quarter each, behind what is left.
_FOLDED = f"t AS (SELECT us, o_orderkey, row_number() OVER (ORDER BY us, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM q WHERE setup = 1 AND us < {LOCKED}), s AS (SELECT *, (place - (n - 3 * (n // 4))) // (n // 4) AS fold FROM t WHERE place >= n - 3 * (n // 4))"


def _setup_sql(alpha: float, tag: str) -> str:
    """The three models of every fold and variant under one penalty."""
    ctes = solve_sql("l", "variant, fold").replace("n + 1 AS d", f"n + {alpha} AS d")
    for name in ("c", "k", "det", "w"):
        ctes = ctes.replace(f"{name} AS (SELECT", f"{name}{tag} AS (SELECT", 1)
    return ctes.replace("FROM c)", f"FROM c{tag})").replace("FROM k)", f"FROM k{tag})").replace("FROM det)", f"FROM det{tag})")


_SAID = " UNION ALL ".join(
    f"SELECT q.us, q.o_orderkey, q.setup, q.t, variant, fold, '{m}' AS model, {a}::DOUBLE AS alpha, {e} AS said FROM q CROSS JOIN w{tag}"
    for tag, a in (("_a", 1.0), ("_b", 2000.0))
    for m, e in (("pooled", "mt + a1 * (x1 - m1)"), ("partial", "CASE WHEN variant = 'alone' THEN mt + a1 * (x1 - m1) ELSE mt + f1 * (x1 - m1) + f2 * (x2 - m2) + f3 * (x3 - m3) END"))
)


@query(
    f"""WITH {X_SQL}, q AS (SELECT o_orderkey, o_custkey % 2 AS setup, epoch_us(o_orderdate) AS us, x1, CASE WHEN o_custkey % 2 = 0 THEN x1 ELSE 0 END AS x2, CASE WHEN o_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x3, t FROM (SELECT x.o_orderkey, x.o_custkey, x.x1, x.t, o_orderdate FROM x JOIN orders USING (o_orderkey))),
{_FOLDED}, b AS (SELECT fold, min(us) AS bound FROM s GROUP BY fold UNION ALL SELECT 3, {LOCKED}),
l AS (SELECT 'combined' AS variant, fold, {SUMS_SQL} FROM q JOIN b ON q.us < b.bound AND q.us < {LOCKED} GROUP BY fold UNION ALL SELECT 'alone' AS variant, fold, {SUMS_SQL} FROM q JOIN b ON q.us < b.bound AND q.us < {LOCKED} AND q.setup = 1 GROUP BY fold),
{_setup_sql(1.0, "_a")}, {_setup_sql(2000.0, "_b")}, y AS ({_SAID}),
v AS (SELECT variant, y.model, alpha, count(*) AS n, avg(abs(said - t)) AS mae FROM y JOIN s ON y.o_orderkey = s.o_orderkey AND y.fold = s.fold GROUP BY ALL),
h AS (SELECT variant, model, alpha, count(*) AS n_locked, avg(abs(said - t)) AS mae_locked FROM y WHERE fold = 3 AND setup = 1 AND us >= {LOCKED} GROUP BY ALL)
SELECT variant, model, alpha, n, round(mae, 6) AS mae, row_number() OVER (ORDER BY round(mae, 9), alpha, variant DESC, model DESC) = 1 AS chosen, n_locked, round(mae_locked, 6) AS mae_locked FROM v JOIN h USING (variant, model, alpha)"""
)
def setup_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one parity as the setup that counts, the others as auxiliary: selection on later rows, then locked ones."""
    x = examples(spark, sf_dir, us=F.unix_micros(F.col("o_orderdate").cast("timestamp")), setup=F.col("o_custkey") % 2)
    scores, models = combined.selected(x.where(F.col("us") < LOCKED), SETUP, 400 * se.BLOCK)
    late = x.where((F.col("us") >= LOCKED) & (F.col("setup") == 1))
    named = models.withColumns({"chosen": F.lit(True), "model": F.concat_ws("/", "variant", "model", F.col("alpha").cast("string"))})
    judged = combined.judged_once(late, named, SETUP, LOCKED - 1)
    part = F.split("model", "/")
    locked = judged.groupBy(part[0].alias("variant"), part[1].alias("model"), part[2].cast("double").alias("alpha")).agg(F.count("*").alias("n_locked"), r6(F.avg(F.abs("error"))).alias("mae_locked"))
    return scores.select("variant", "model", "alpha", "n", r6("mae").alias("mae"), "chosen").join(locked, ["variant", "model", "alpha"])
