"""Operator 4: mixing sources to target weights by entropy balancing.

Each document gets a rate, 1 at first. The rates that stay closest to 1 in relative entropy while every
source's words add up to its target are exponentially tilted: rate = min(CAP, exp(l_s * size / mean_s)),
with one dual variable l_s a source. Newton's method finds them: each step is one distributed sum over
the (source, size) histogram, safeguarded by a bracket. Rates become whole copies by adding a hash of the
row and one offset a source, whose value makes the copies' words meet the target; the offset comes from
two distributed histograms of the places where a document's copies change.

Only one row a source comes to the driver. Defined results: a null text has size 0; a null source is a
source of its own, after all others; a source without words has target 0; a row's hash is of doc_id, text
and its number among rows equal in doc_id, text and source, so that null and repeated ids are rounded
each for itself; other columns, whatever their names, pass through mix() untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carried, cut, text_or_empty, unfolded

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
BINS = 4096
#: Turns of rounding: each later one fills what is left with documents that fit in.
TURNS = 3
#: Beyond so many sources their table is joined by a shuffle.
BROADCAST_SOURCES = 20_000
SEED = 7


def size_of(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(by_size: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, docs, target of each source, from its histogram (source, size, n).

    Filled to one level: in ascending order of limit to weight, a source stops at its limit as long as
    that lies below its share of what the stopped ones leave.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())  # a row a source
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    filled = Window.orderBy("__ratio", "__rank")
    upto = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(0, Window.unboundedFollowing)
    s = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    s = s.select("*", w.alias("__w"), F.row_number().over(names).alias("__rank"), (F.col("source_size") * F.lit(cap)).alias("__cap"))
    s = s.withColumn("__ratio", F.col("__cap") / F.col("__w")).withColumn("__all", F.sum("source_size").over(every) * F.lit(share))
    level = (F.col("__all") - F.coalesce(F.sum("__cap").over(upto), F.lit(0.0))) / F.sum("__w").over(onward)
    s = s.withColumns({"__level": level, "__pos": F.row_number().over(filled)})
    s = s.withColumn("__first", F.min(F.when(F.col("__ratio") > F.col("__level"), F.col("__pos"))).over(every))
    s = s.withColumn("__tau", F.max(F.when(F.col("__pos") == F.col("__first"), F.col("__level"))).over(every))
    return s.select("source", "source_size", "docs", F.when(F.col("__tau").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__w") * F.col("__tau"))).alias("target"))


def _joined(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """df with the sources' rows (source first)."""
    small = df.sparkSession.createDataFrame(rows, "source string, " + schema).withColumnRenamed("source", "__s")
    small = F.broadcast(small) if len(rows) <= BROADCAST_SOURCES else small
    return df.join(small, df["source"].eqNullSafe(small["__s"])).drop("__s")


def tilt(by_size: DataFrame, sources: list, cap: float = CAP, steps: int = 60, near: float = 1e-10) -> dict:
    """The dual variable of each source."""
    mean = {r.source: r.source_size / r.docs for r in sources}
    out, lo, hi = {}, {}, {}
    for r in sources:
        if r.source_size == 0:
            out[r.source] = 0.0
            continue
        hi[r.source] = math.log(cap) * mean[r.source]  # there every document with words is at the limit
        out[r.source] = hi[r.source] if r.target >= cap * r.source_size else 0.0
    open_ = {r.source: r.target for r in sources if r.source_size and r.target < cap * r.source_size}
    x = F.col("size") / F.col("mean")
    rate = F.exp(F.col("l") * x)
    for _ in range(steps):
        if not open_:
            break
        now = _joined(by_size, [(s, out[s], mean[s]) for s in open_], "l double, mean double")
        found = now.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * F.least(F.lit(cap), rate)).alias("words"),
            F.sum(F.when(rate < cap, F.col("n") * F.col("size") * x * rate)).alias("slope"),
        ).collect()  # a row a source
        for r in found:
            s, l, off = r.source, out[r.source], r.words - open_[r.source]
            if abs(off) <= near * max(1.0, open_[s]):
                del open_[s]
                continue
            (hi if off > 0 else lo)[s] = l
            step = l - off / r.slope if r.slope else None
            if s not in lo:
                low = l - max(1.0, 2 * abs(l))
                out[s] = max(step, low) if step is not None else low
            else:
                out[s] = step if step is not None and lo[s] < step < hi[s] else (lo[s] + hi[s]) / 2
            if s in lo and hi[s] - lo[s] < 1e-14 * max(1.0, abs(l)):
                del open_[s]
    return {s: float(f"{l:.10g}") for s, l in out.items()}


def offsets(places: DataFrame, want: dict, low: dict, limit: dict, cap: float = CAP) -> tuple[dict, dict]:
    """(offset, words up to it) of each source: as many places from low on, of documents within limit, as want holds.

    A document's copies grow by one where the offset passes k - rate - u; the words up to an offset are
    a running sum over those places, read off two histograms of BINS bins.
    """
    low, words = dict(low), dict.fromkeys(low, 0)
    width = {s: cap - v if v < cap else 1.0 for s, v in low.items()}
    for _ in range(2):
        now = _joined(places, [(s, low[s], width[s] / BINS, float(limit[s])) for s in low], "low double, step double, most double")
        binned = now.where("size <= most").withColumn("bin", F.floor((F.col("at") - F.col("low")) / F.col("step"))).where(F.col("bin").between(0, BINS - 1))
        sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        sums = _joined(sums, [(s, float(want[s] - words[s])) for s in low], "left double")
        best = sums.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("sum"), F.min(F.when(F.col("upto") > F.col("left"), F.col("bin"))).alias("over"))
        for r in best.collect():  # a row a source
            s, step = r.source, width[r.source] / BINS
            words[s] += r.sum or 0
            # without a bin that exceeds what is left, all are taken
            low[s], width[s] = (low[s] + width[s], 1.0) if r.over is None else (low[s] + r.over * step, step)
    return low, words


SAME = ["doc_id", "source", "text_hash"]


def _keys(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"], docs["source"], size_of().alias("size"), F.xxhash64("text").alias("text_hash")]


def _numbered(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """rows with their number (nth) among equal ones; only repeated rows are dealt out for that."""
    if repeated is None:
        return rows.withColumn("nth", F.lit(1))
    same = repeated.select(*(F.col(c).alias(f"same_{c}") for c in SAME))
    on = [F.col(c).eqNullSafe(F.col(f"same_{c}")) for c in SAME]
    once = rows.join(same, on, "left_anti").withColumn("nth", F.lit(1))
    return once.unionByName(rows.join(same, on, "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy(*SAME).orderBy("size"))))


def _taken(docs: DataFrame, row: Column | None, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """row (if given) beside doc_id, size, source_size, target and copies (0 to cap) of each row of docs."""
    light = cut(docs.select(*_keys(docs)))
    rows = light if row is None else docs.select(row.alias("row"), *_keys(docs))
    repeated = cut(light.groupBy(*SAME).agg(F.count("*").alias("n")).where("n > 1"))
    repeated = None if repeated.isEmpty() else repeated
    by_size = cut(light.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = targets(by_size, weights, share, cap).collect()  # a row a source
    dual = tilt(by_size, sources, cap)
    mean = {r.source: r.source_size / r.docs for r in sources}
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text_hash", "nth"), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    rate = F.least(F.lit(cap), F.exp(F.col("l") * F.col("size") / F.greatest("mean", F.lit(1e-300))))
    table = [(r.source, dual[r.source], mean[r.source], int(r.source_size), float(r.target)) for r in sources]
    rated = lambda df: _joined(_numbered(df, repeated), table, "l double, mean double, source_size long, target double").withColumns({"u": u, "rate": rate})
    places = cut(rated(light).where("size > 0").select("source", "size", "rate", "u"))
    places = places.select("source", "size", F.explode(F.array(*[F.lit(k) - F.col("rate") - F.col("u") for k in range(1, int(cap) + 1)])).alias("at"))
    left, low, limit = {r.source: float(r.target) for r in sources}, {r.source: -cap for r in sources}, {r.source: math.inf for r in sources}
    full = rated(rows)
    for turn in range(TURNS):
        shift, words = offsets(places, left, low, limit, cap)
        full = _joined(full, [(s, low[s], float(limit[s]), v) for s, v in shift.items()], f"low{turn} double, most{turn} double, shift{turn} double")
        left = {s: left[s] - words[s] for s in left}
        low, limit = shift, left

    # the same places as in offsets(): one copy more for each that a turn takes
    def took(k: int) -> Column:
        at = F.lit(k) - F.col("rate") - F.col("u")
        hit = F.lit(False)
        for t in range(TURNS):
            hit = hit | ((F.col("size") <= F.col(f"most{t}")) & (at >= F.col(f"low{t}")) & (at < F.col(f"shift{t}")))
        return F.when(hit, 1).otherwise(0)

    made = sum((took(k) for k in range(1, int(cap) + 1)), F.lit(0))
    return full.select(*["row"] * (row is not None), "doc_id", "size", "source_size", "target", made.cast("int").alias("copies"))


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs with size, source_size, target and copies (0 to cap); needs doc_id, text and source. Columns of those names are replaced."""
    made = ["size", "source_size", "target", "copies"]
    return _taken(docs, carried(docs.columns), weights, share, cap).select(*(c for name, c in zip(docs.columns, unfolded(docs.columns), strict=True) if name not in made), *made)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    picked = _taken(docs, carried(docs.columns), weights, share, cap).where("copies > 0")
    return picked.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select(*unfolded(docs.columns))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    return _taken(docs, None, WEIGHTS, SHARE, CAP).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
