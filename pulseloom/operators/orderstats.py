"""Order statistics at any size: medians over wide frames of rows, and quantiles of huge groups.

A wide frame is kept in a counted tree over the ranks of a chunk's values, so that a row costs the logarithm of the
chunk, not the frame; chunks are ranges of rows with the frame's reach on either side. A quantile of a group is found
by counting values in bins between two bounds and narrowing the bounds to the bin that holds its rank; only
histograms are shuffled, and no task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import BLOCK, block_of

#: Rows of a chunk beside its reach, bins of a histogram, and values that are sorted outright.
CHUNK, BINS, FINISH = 50_000, 1024, 4096


def numbered(df: DataFrame, keys: list[str], time: str, tie: str, name: str, block: int = BLOCK) -> DataFrame:
    """df with each row's place in its key, from 0: places within a block of time, and a row a block for those before it."""
    d = df.withColumn("__block", block_of(F.col(time), block))
    own = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(time, tie)) - 1
    sizes = d.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*(F.col(c).alias(f"__of_{c}") for c in (*keys, "__block")), F.coalesce(before, F.lit(0)).alias("__before"))
    d = d.withColumn("__own", own).join(sizes, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*keys, "__block")])
    return d.select(*df.columns, (F.col("__own") + F.col("__before")).alias(name))


class CountedTree:
    """How many of some ranks are present: add, remove, and the rank at a place, each in logarithmic time."""

    def __init__(self, n: int):
        self.n, self.top = n, 1 << max(n.bit_length() - 1, 0)
        self.sums, self.count = [0] * (n + 1), 0

    def add(self, rank: int, by: int = 1) -> None:
        self.count += by
        rank += 1
        while rank <= self.n:
            self.sums[rank] += by
            rank += rank & -rank

    def at(self, place: int) -> int:
        """The rank of the place-th present one, from 0."""
        node, step = 0, self.top
        while step:
            if node + step <= self.n and self.sums[node + step] <= place:
                node += step
                place -= self.sums[node]
            step >>= 1
        return node


def sliding_medians(x: np.ndarray, first: int, last: int, before: int, after: int) -> np.ndarray:
    """For each row from first up to last, the median of x over so many rows before and after it; NaN in x is no value."""
    some = np.flatnonzero(~np.isnan(x))
    order = some[np.argsort(x[some], kind="stable")]
    rank = np.full(len(x), -1)
    rank[order] = np.arange(len(order))
    ranks, values = rank.tolist(), x[order].tolist()
    tree, out = CountedTree(len(order)), np.full(last - first, np.nan)
    low = high = max(0, first - before)
    for i in range(first, last):
        while high < min(len(x), i + after + 1):
            if ranks[high] >= 0:
                tree.add(ranks[high])
            high += 1
        while low < i - before:
            if ranks[low] >= 0:
                tree.add(ranks[low], -1)
            low += 1
        n = tree.count
        if n:
            a = values[tree.at((n - 1) // 2)]
            out[i - first] = a if n % 2 else (a + values[tree.at(n // 2)]) / 2
    return out


def rolling_median(df: DataFrame, keys: list[str], time: str, tie: str, value: str, before: int, after: int, name: str = "mid", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """keys, time, tie and the median of value over the frame of so many rows before and after; null values are left out."""
    rows = numbered(df.select(*keys, time, tie, F.col(value).cast("double").alias("__value")), keys, time, tie, "__at", block)
    of = lambda c: F.floor(c / chunk).cast("long")
    met = rows.withColumn("__chunk", F.explode(F.sequence(of(F.greatest(F.col("__at") - after, F.lit(0))), of(F.col("__at") + before))))
    k = len(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: k + 2]) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def solve(number: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            at = t.column("__at").to_numpy()
            own = np.flatnonzero(at // chunk == number)
            if not len(own):  # beyond the last row
                return None
            a, z = int(own[0]), int(own[-1]) + 1
            mid = sliding_medians(t.column("__value").to_numpy().astype(float), a, z, before, after)
            part = t.slice(a, z - a)
            return pa.RecordBatch.from_arrays([*(part.column(i).combine_chunks() for i in range(k + 2)), pa.array(mid, from_pandas=True)], names=[*t.column_names[: k + 2], name])

        for batch in batches:
            start = 0
            cols = [batch.column(c).to_pylist() for c in (*keys, "__chunk")]
            for i, key in enumerate(zip(*cols, strict=True)):
                if key != now:
                    held.append(batch.slice(start, i - start))
                    if now is not None and (made := solve(now[-1])) is not None:
                        yield made
                    held.clear()
                    now, start = key, i
            held.append(batch.slice(start))
        if now is not None and (made := solve(now[-1])) is not None:
            yield made

    dealt = met.repartition(parts, *keys, "__chunk").sortWithinPartitions(*keys, "__chunk", "__at")
    return dealt.select(*keys, time, tie, "__value", "__at", "__chunk").mapInArrow(run, schema)


def quantiles(df: DataFrame, keys: list[str], value: str, q: float = 0.5, name: str = "mid", bins: int = BINS, finish: int = FINISH) -> DataFrame:
    """Each group's exact quantile of its finite values, linear between two ranks; groups without any have no row.

    df is read once for each narrowing, a few times whatever its size, as each divides the span that is left by bins.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("__v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    place = (F.col("n") - 1) * F.lit(float(q))
    state = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    state = state.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))).select(*keys, "n", "rank", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    by = [*keys, "rank"]
    found = None
    while True:
        state = state.persist()  # a row a group and rank
        one = state.where("low = high").select(*by, "n", F.col("low").alias("x"))
        small = state.where(f"low < high and inside <= {finish}")
        near = _within(rows, small, keys).groupBy(*by, "n", "below").agg(F.sort_array(F.collect_list("__v")).alias("all"))
        done = one.unionByName(near.select(*by, "n", F.get("all", (F.col("rank") - F.col("below")).cast("int")).alias("x")))
        found = done if found is None else found.unionByName(done)
        many = state.where(f"low < high and inside > {finish}")
        if many.isEmpty():
            break
        # halves, as the whole span may be beyond a double
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("__v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins))
        seen = _within(rows, many, keys).groupBy(*by, "n", "below", bin_.alias("bin")).agg(F.count("*").alias("inside"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = F.sum("inside").over(Window.partitionBy(*by).orderBy("bin"))
        seen = seen.withColumn("upto", F.col("below") + upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("inside") <= F.col("rank")))
        state = seen.select(*by, "n", "low", "high", (F.col("upto") - F.col("inside")).alias("below"), "inside")
    at = F.col("n") - 1
    share = at * F.lit(float(q)) - F.floor(at * F.lit(float(q)))
    both = found.groupBy(*keys).agg(F.max("n").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
    return both.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * share).alias(name))


def _within(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """rows beside the bounds of their group that hold them."""
    s = state.select(*(F.col(c).alias(f"__of_{c}") for c in keys), *(c for c in state.columns if c not in keys))
    on = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in keys]
    return rows.join(s, on).where((F.col("__v") >= F.col("low")) & (F.col("__v") <= F.col("high")))


def robust_thresholds(df: DataFrame, keys: list[str], value: str, sigmas: float = 6.0, scale: float = 1.4826, **limits: int) -> DataFrame:
    """Each key's median (mid), scaled MAD (mad) and the threshold that lies sigmas MADs above."""
    mid = quantiles(df, keys, value, name="mid", **limits)
    own = mid.select(*(F.col(c).alias(f"__of_{c}") for c in keys), "mid")
    off = df.select(*keys, value).join(own, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in keys]).select(*keys, F.abs(F.col(value) - F.col("mid")).alias("__off"))
    mad = quantiles(off, keys, "__off", name="mad", **limits).select(*(F.col(c).alias(f"__of_{c}") for c in keys), (F.col("mad") * F.lit(scale)).alias("mad"))
    d = mid.join(mad, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in keys]).select(*keys, "mid", "mad")
    return d.withColumn("threshold", F.col("mid") + F.lit(sigmas) * F.col("mad"))
