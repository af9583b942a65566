"""Prefix scans over long series in blocks of time, so that a device's year is many tasks.

A block's rows, in order, are a map from the state before the block to the state behind it. Such maps compose: first each
block's map is found by itself, then the maps of a key are applied one after another (a row a block), then each block is
run again from the state it begins with. Every shuffle is by key and block; the two passes over the rows share one.

What a row needs of the rows just before it (whether a gap parts them, whether a session has only begun) comes from a
halo: the rows of the time reach before a block are sent to it as well. A gap longer than the reach is then the same as
no row at all.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import BLOCK, block_of

#: step(time, value, halo), called for each row of a block in order, the halo's first.
Step = Callable[[int, float | None, bool], Any]


@dataclass(frozen=True)
class Mean:
    """The recursive mean g += alpha * (x - g), begun at a session's first value: an affine map of g.

    A row without a value shows the mean so far.
    """

    alpha: float
    gap: int
    kind: str = "double"

    @property
    def reach(self) -> int:
        return self.gap

    def outline(self, start: int) -> tuple[Step, Callable[[], list]]:
        last, own, a, b, first = None, False, 1.0, 0.0, None

        def step(at: int, x: float | None, halo: bool) -> None:
            nonlocal last, own, a, b, first
            if not halo:
                if last is None or at - last > self.gap:
                    own, first = True, None
                if x is not None:
                    first = x if first is None else first + self.alpha * (x - first)
                    a, b = a * (1 - self.alpha), b + self.alpha * (x - b)
            last = at

        return step, lambda: [own, a, b, first]

    def behind(self, entry: float | None, outline: list) -> float | None:
        own, a, b, first = outline
        if own or entry is None:
            return first
        return entry if first is None else a * entry + b

    def run(self, entry: float | None, start: int) -> Step:
        g, last = entry, None

        def step(at: int, x: float | None, halo: bool) -> float | None:
            nonlocal g, last
            if not halo:
                if last is None or at - last > self.gap:
                    g = None
                if x is not None:
                    g = x if g is None else g + self.alpha * (x - g)
            last = at
            return g

        return step


@dataclass(frozen=True)
class Dwelling:
    """1 once a value has been over enter for the time enter_for, 0 once under leave for leave_for, null before.

    Rows within warm_up of a session's first are not looked at. The state is (shown, over since, under since). A
    block's map is given by its first run of rows over enter or under leave, which may have begun before the block,
    and by what follows from the rows behind that run alone.
    """

    enter: float
    leave: float
    enter_for: int
    leave_for: int
    warm_up: int
    gap: int
    kind: str = "int"

    @property
    def reach(self) -> int:
        return self.gap + self.warm_up

    def _side(self, x: float | None) -> int:
        return 0 if x is None else 1 if x > self.enter else -1 if x < self.leave else 0

    def _next(self, state: list, at: int, side: int) -> list:
        shown, over, under = state
        over = (at if over is None else over) if side > 0 else None
        under = (at if under is None else under) if side < 0 else None
        if over is not None and at - over >= self.enter_for:
            shown = 1
        elif under is not None and at - under >= self.leave_for:
            shown = 0
        return [shown, over, under]

    def _seen(self, start: int) -> Callable[[int, bool], tuple[bool, bool]]:
        """For each row in order: whether a session begins with it, and whether it is looked at."""
        last = begun = None

        def see(at: int, halo: bool) -> tuple[bool, bool]:
            nonlocal last, begun
            # the halo's first row begins a session if a row before it, within a gap, would be in the halo too; an
            # earlier one has its warm-up behind it when the block starts
            new = not halo or at >= start - self.warm_up if last is None else at - last > self.gap
            last, begun = at, at if new else begun
            return new, begun is None or at - begun >= self.warm_up

        return see

    def outline(self, start: int) -> tuple[Step, Callable[[], list]]:
        see, own, state = self._seen(start), False, [None, None, None]
        side, since, until, open_ = 0, None, None, True

        def step(at: int, x: float | None, halo: bool) -> None:
            nonlocal own, state, side, since, until, open_
            new, looked = see(at, halo)
            if halo:
                return
            if new:
                own, open_, state = True, False, [None, None, None]
            if not looked:
                return
            now = self._side(x)
            if open_ and now and side in (0, now):
                side, since, until = now, at if since is None else since, at
                return
            open_ = False
            state = self._next(state, at, now)

        return step, lambda: [own, state, side, since, until, open_]

    def behind(self, entry: list | None, outline: list) -> list:
        own, state, side, since, until, open_ = outline
        if own:
            return state
        shown, over, under = entry or [None, None, None]
        if side:
            over, under = (since if over is None else over, None) if side > 0 else (None, since if under is None else under)
            shown = self._next([shown, over, under], until, side)[0]
        if open_:
            return [shown, over, under]
        return [shown if state[0] is None else state[0], *state[1:]]

    def run(self, entry: list | None, start: int) -> Step:
        see, state = self._seen(start), entry or [None, None, None]

        def step(at: int, x: float | None, halo: bool) -> int | None:
            nonlocal state
            new, looked = see(at, halo)
            if not halo:
                state = [None, None, None] if new else state
                if looked:
                    state = self._next(state, at, self._side(x))
            return state[0]

        return step


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"__of_{c}"]) for c in names])


def scanned(df: DataFrame, keys: list[str], time: str, tie: str, value: str, name: str, scan: Mean | Dwelling, block: int = BLOCK) -> DataFrame:
    """keys, time, tie and the column name: for each key in order what the scan shows, computed in blocks of so many microseconds.

    Rows stream through; a task holds one block's state. The halo of a block is what lies within scan.reach before it.
    """
    k = len(keys)
    rows = df.select(*keys, F.col(time).cast("long").alias(time), tie, F.col(value).cast("double").alias("__value"))
    at = block_of(F.col(time), block)
    own = rows.withColumns({"__block": at, "__halo": F.lit(False)})
    last = block_of(F.col(time) + scan.reach, block)
    ahead = rows.where(last > at).withColumns({"__block": F.explode(F.sequence(at + 1, last)), "__halo": F.lit(True)})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, "__block"]
    dealt = own.unionByName(ahead).repartition(parts, *by)
    order = [*by, time, tie]
    fields = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema}
    of_key = ", ".join(fields[c] for c in by)

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step, result, any_own = None, None, None, False

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(by, now, strict=True)) | {"outline": json.dumps(result())}], schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(c) for c in by] + [pa.field("outline", pa.string())])
            for *key, t, x, halo in zip(*(batch.column(c).to_pylist() for c in (*by, time, "__value", "__halo")), strict=True):
                if key != now:
                    if any_own:
                        yield made()
                    now, any_own = key, False
                    step, result = scan.outline(key[-1] * block)
                step(t, x, halo)
                any_own = any_own or not halo
        if any_own:
            yield made()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for *key, outline in zip(*(c.to_pylist() for c in (*batch.columns[:k], batch.column("outline"))), strict=True):
                if key != now:
                    now, state = key, None
                out.append(json.dumps(state))
                state = scan.behind(state, json.loads(outline))
            yield pa.RecordBatch.from_arrays([*batch.columns[: k + 1], pa.array(out, pa.string())], names=[*by, "entry"])

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            out = []
            for *key, t, x, halo, entry in zip(*(batch.column(c).to_pylist() for c in (*by, time, "__value", "__halo", "__entry")), strict=True):
                if key != now:
                    now, step = key, scan.run(json.loads(entry or "null"), key[-1] * block)
                out.append(step(t, x, halo))
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, time, tie)), pa.array(out, pa.float64() if scan.kind == "double" else pa.int32())], names=[*keys, time, tie, name])
            yield made.filter(pc.invert(batch.column("__halo")))

    found = dealt.sortWithinPartitions(*order).mapInArrow(outlines, f"{of_key}, outline string")
    begun = found.repartition(parts, *keys).sortWithinPartitions(*by).mapInArrow(entries, f"{of_key}, entry string")
    begun = begun.select(*(F.col(c).alias(f"__of_{c}") for c in by), F.col("entry").alias("__entry"))
    met = dealt.join(begun, _same(dealt, begun, by), "left").select(*dealt.columns, "__entry")
    schema = ", ".join(fields[c] for c in (*keys, time, tie)) + f", `{name}` {scan.kind}"
    return met.repartition(parts, *by).sortWithinPartitions(*order).mapInArrow(shown, schema)


def exponential(df: DataFrame, keys: list[str], time: str, tie: str, value: str, alpha: float, gap: int, name: str = "ema", block: int = BLOCK) -> DataFrame:
    """The recursive mean of each key's values, begun anew behind a gap."""
    return scanned(df, keys, time, tie, value, name, Mean(alpha, gap), block)


def dwelling(df: DataFrame, keys: list[str], time: str, tie: str, value: str, enter: float, leave: float, enter_for: int, leave_for: int, warm_up: int, gap: int, block: int = BLOCK) -> DataFrame:
    """Each row's state by hysteresis with dwell times, begun anew behind a gap."""
    return scanned(df, keys, time, tie, value, "state", Dwelling(enter, leave, enter_for, leave_for, warm_up, gap), block)
