"""Order-dependent operators over keyed time series: differences, gaps, sessions, rolling frames, masks.

All work on a partition of keys in time order; only the recursive ones need Python, which carries their state
from row to row. `tie` orders rows of equal time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.expr import MAD_SCALE, median


#: A day of microseconds: the blocks that long series are cut into.
BLOCK = 86_400_000_000


def block_of(time: Column, block: int) -> Column:
    """The number of the block of so many microseconds that holds a time, also before 1970."""
    t = time.cast("long")
    return ((t - F.pmod(t, F.lit(block))) / block).cast("long")  # a whole multiple, which doubles divide exactly


def in_order(keys: list[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def with_deltas(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """df with dt, the time since the key's row before, and dseq, the step of tie."""
    w = in_order(keys, time, tie)
    return df.withColumns({"dt": F.col(time) - F.lag(time).over(w), "dseq": F.col(tie) - F.lag(tie).over(w)})


def gap_events(df: DataFrame, keys: list[str], time: str, tie: str, longest: int) -> DataFrame:
    """A row for each step longer than longest: before, after, span and midpoint."""
    d = with_deltas(df, keys, time, tie).where(F.col("dt") > longest)
    return d.select(*keys, F.col(tie).alias("after_id"), (F.col(time) - F.col("dt")).alias("before_us"), F.col(time).alias("after_us"), F.col("dt").alias("span_us"), (F.col(time) - F.expr("dt div 2")).alias("mid_us"))


def with_sessions(df: DataFrame, keys: list[str], time: str, tie: str, longest: int) -> DataFrame:
    """df with session: it grows by one behind each gap longer than longest."""
    d = with_deltas(df, keys, time, tie)
    return d.withColumn("session", F.sum(F.when(F.col("dt") > longest, 1).otherwise(0)).over(in_order(keys, time, tie)).cast("long"))


def islands(df: DataFrame, keys: list[str], time: str, tie: str, flag: Column) -> DataFrame:
    """The unbroken runs of rows that satisfy flag: start, end and number of rows."""
    w = in_order(keys, time, tie)
    d = df.withColumn("__flag", F.coalesce(flag, F.lit(False)))
    d = d.withColumn("__new", F.when(F.col("__flag") & ~F.coalesce(F.lag("__flag").over(w), F.lit(False)), 1).otherwise(0))
    d = d.withColumn("run", F.sum("__new").over(w).cast("long")).where("__flag")
    return d.groupBy(*keys, "run").agg(F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count("*").alias("n_rows"))


def rolling(df: DataFrame, keys: list[str], time: str, tie: str, before: int, after: int, **made: Column) -> DataFrame:
    """df with aggregates over the frame of so many rows before and after."""
    w = in_order(keys, time, tie).rowsBetween(-before, after)
    return df.withColumns({k: c.over(w) for k, c in made.items()})


def dilated(df: DataFrame, keys: list[str], time: str, tie: str, mask: Column, k: int, name: str = "dilated") -> DataFrame:
    """df with name: whether mask holds for a row up to k rows away."""
    w = in_order(keys, time, tie).rowsBetween(-k, k)
    return df.withColumn(name, F.max(F.coalesce(mask, F.lit(False)).cast("int")).over(w) == 1)


def robust_thresholds(df: DataFrame, keys: list[str], value: str, sigmas: float = 6.0) -> DataFrame:
    """Each key's median, scaled MAD and the threshold that lies sigmas MADs above."""
    m = df.groupBy(*keys).agg(median(value).alias("mid"))
    d = df.join(m, keys).groupBy(*keys).agg(F.first("mid").alias("mid"), (F.lit(MAD_SCALE) * median(F.abs(F.col(value) - F.col("mid")))).alias("mad"))
    return d.withColumn("threshold", F.col("mid") + F.lit(sigmas) * F.col("mad"))


def carried(df: DataFrame, keys: list[str], order: list[str], block: str, *marks: tuple[Column, dict[str, Column]]) -> DataFrame:
    """df with, for each mark (valid, columns), the columns as in the last row of its key, at or before each row, that is valid.

    Rows look back within their block; what lies before it comes from a row a block, so no window holds a key's whole
    history. block must not fall along order.
    """
    at = range(len(marks))
    d = df.withColumns({f"__now{i}": F.when(valid, F.struct(*(c.alias(k) for k, c in columns.items()))) for i, (valid, columns) in enumerate(marks)})
    back = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = d.groupBy(*keys, block).agg(*(F.max_by(f"__now{i}", F.when(F.col(f"__now{i}").isNotNull(), F.struct(*order))).alias(f"__end{i}") for i in at))
    ahead = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(c).alias(f"__of_{c}") for c in (*keys, block)), *(F.last(f"__end{i}", ignorenulls=True).over(ahead).alias(f"__before{i}") for i in at))
    d = d.withColumns({f"__here{i}": F.last(f"__now{i}", ignorenulls=True).over(back) for i in at})
    d = d.join(ends, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*keys, block)], "left")
    return d.select(*df.columns, *(F.coalesce(f"__here{i}", f"__before{i}").getField(k).alias(k) for i in at for k in marks[i][1]))


def followed(df: DataFrame, keys: list[str], order: str, block: str, column: str, name: str) -> DataFrame:
    """df with column as it is in the key's next row; a block's last row finds it in a row a block."""
    here = F.lead(F.struct(column)).over(Window.partitionBy(*keys, block).orderBy(order))
    first = df.groupBy(*keys, block).agg(F.min_by(F.struct(column), order).alias("__first"))
    ahead = F.lead("__first").over(Window.partitionBy(*keys).orderBy(block))
    first = first.select(*(F.col(c).alias(f"__of_{c}") for c in (*keys, block)), ahead.alias("__ahead"))
    d = df.withColumn("__here", here).join(first, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*keys, block)], "left")
    return d.select(*df.columns, F.coalesce("__here", "__ahead").getField(column).alias(name))


def held(df: DataFrame, keys: list[str], time: str, tie: str, value: Column, longest: int, block: int = BLOCK) -> DataFrame:
    """df with the last valid value at or before each row, its age, and current, held or unavailable."""
    d = df.withColumns({"__value": value, "__block": block_of(F.col(time), block)})
    d = carried(d, keys, [time, tie], "__block", (F.col("__value").isNotNull(), {"held_value": F.col("__value"), "held_us": F.col(time)})).drop("__value", "__block")
    d = d.withColumn("age_us", F.col(time) - F.col("held_us"))
    mode = F.when(F.col("age_us") == 0, "current").when(F.col("age_us") <= longest, "held").otherwise("unavailable")
    return d.withColumn("mode", mode).withColumn("shown", F.when(F.col("mode") != "unavailable", F.col("held_value")))


def interpolated(df: DataFrame, keys: list[str], time: str, tie: str, value: Column, name: str = "filled") -> DataFrame:
    """df with value filled in linearly over time between the nearest rows that have one; outside them null."""
    back = in_order(keys, time, tie).rowsBetween(Window.unboundedPreceding, 0)
    ahead = in_order(keys, time, tie).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(value.isNotNull(), F.col(time))
    d = df.withColumns({"__v0": F.last(value, True).over(back), "__t0": F.last(at, True).over(back), "__v1": F.first(value, True).over(ahead), "__t1": F.first(at, True).over(ahead)})
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col(time) - F.col("__t0")) / (F.col("__t1") - F.col("__t0"))
    return d.withColumn(name, F.when(F.col("__t0") == F.col("__t1"), F.col("__v0")).when(F.col("__t1") > F.col("__t0"), line)).drop("__v0", "__v1", "__t0", "__t1")


def scanned(df: DataFrame, keys: list[str], time: str, tie: str, value: str, made: str, start: Callable[[], Callable]) -> DataFrame:
    """keys, time, tie and the column made ("name type"): for each key, in order, what start()(time, value) returns.

    Rows stream through in sorted order and only one key's state is held, whatever a key's length; a null value
    is passed on as None.
    """
    rows = df.select(*keys, time, tie, F.col(value).cast("double").alias("__value"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), made])
    k, names = len(keys), [*keys, time, tie, made.split()[0]]
    kind = pa.float64() if made.endswith(" double") else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            cols = [c.to_pylist() for c in (*batch.columns[:k], batch.column("__value"), batch.column(k).cast(pa.int64()))]
            out = []
            for *key, x, at in zip(*cols, strict=True):
                if step is None or key != now:
                    now, step = key, start()
                out.append(step(at, x))
            yield pa.RecordBatch.from_arrays([*batch.columns[: k + 2], pa.array(out, kind)], names=names)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, time, tie).mapInArrow(run, schema)


def thinned(df: DataFrame, keys: list[str], at: str, apart: int) -> DataFrame:
    """keys and at of the rows that lie more than apart behind the last row of their key that was kept."""

    def start() -> Callable:
        last = None

        def step(now: int, x: float | None) -> int:
            nonlocal last
            keep = last is None or now - last > apart
            last = now if keep else last
            return int(keep)

        return step

    d = scanned(df.select(*keys, at).withColumn("__tie", F.lit(0)).withColumn("__none", F.lit(None).cast("double")), keys, at, "__tie", "__none", "__kept int", start)
    return d.where("__kept = 1").select(*keys, at)


def spaced_tops(df: DataFrame, keys: list[str], time: str, tie: str, value: str, least: Column, apart: int) -> DataFrame:
    """keys, time, tie, value and nth of the local maxima over least that lie at least apart; a nearer one takes the last one's place if it is higher.

    Only local maxima are run through in order, with one top in memory; windows see neighbours alone.
    """
    w = in_order(keys, time, tie)
    d = df.withColumns({"__a": F.lag(value).over(w), "__b": F.lead(value).over(w)})
    d = d.where((F.col(value) > least) & (F.col(value) >= F.col("__a")) & (F.col(value) > F.col("__b")))

    def start() -> Callable:
        last = top = None

        def step(at: int, x: float | None) -> int:
            """1 a new top, 2 one in place of the last, 0 neither."""
            nonlocal last, top
            far = last is None or at - last >= apart
            if far or x > top:
                last, top = at, x
                return 1 if far else 2
            return 0

        return step

    run = scanned(d.select(*keys, time, tie, value), keys, time, tie, value, "__step int", start).where("__step > 0")
    run = run.withColumns({"nth": F.sum(F.when(F.col("__step") == 1, 1).otherwise(0)).over(w).cast("long"), "__next": F.lead("__step").over(w)})
    kept = run.where("__next is null or __next = 1").select(*keys, time, tie, "nth")
    return d.select(*keys, time, tie, value).join(kept, [*keys, time, tie])


def exponential(df: DataFrame, keys: list[str], time: str, tie: str, value: str, alpha: float, name: str = "ema") -> DataFrame:
    """Each key's values in order with the recursive mean g += alpha * (x - g), begun at the first value.

    A row without a value shows the mean so far.
    """

    def start() -> Callable:
        g = None

        def step(at: int, x: float | None) -> float | None:
            nonlocal g
            if x is not None:
                g = x if g is None else g + alpha * (x - g)
            return g

        return step

    return scanned(df, keys, time, tie, value, f"{name} double", start)


def hysteresis(df: DataFrame, keys: list[str], time: str, tie: str, value: str, enter: float, leave: float, enter_rows: int, leave_rows: int) -> DataFrame:
    """Each row's state: 1 once value has been over enter for enter_rows rows in a row, 0 once under leave for leave_rows."""

    def start() -> Callable:
        state = up = down = 0

        def step(at: int, x: float | None) -> int:
            nonlocal state, up, down
            up = up + 1 if x is not None and x > enter else 0
            down = down + 1 if x is not None and x < leave else 0
            if state == 0 and up >= enter_rows:
                state = 1
            elif state == 1 and down >= leave_rows:
                state = 0
            return state

        return step

    return scanned(df, keys, time, tie, value, "state int", start)


def dwelling(df: DataFrame, keys: list[str], time: str, tie: str, value: str, enter: float, leave: float, enter_for: int, leave_for: int, warm_up: int) -> DataFrame:
    """Each row's state: 1 once value has been over enter for the time enter_for, 0 once under leave for leave_for.

    It is null (calibrating) until the first of these; rows within warm_up of the key's first one are not looked at.
    """

    def start() -> Callable:
        first = state = above = below = None

        def step(at: int, x: float | None) -> int | None:
            nonlocal first, state, above, below
            first = at if first is None else first
            if at - first < warm_up:
                return state
            above = (at if above is None else above) if x is not None and x > enter else None
            below = (at if below is None else below) if x is not None and x < leave and above is None else None
            if above is not None and at - above >= enter_for:
                state = 1
            elif below is not None and at - below >= leave_for:
                state = 0
            return state

        return step

    return scanned(df, keys, time, tie, value, "state int", start)
