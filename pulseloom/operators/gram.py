"""Ridge models from sums alone: every feature set, target and held-out group from one pass over the rows.

A group's moments are sums of products of values moved by their overall means, so that they add up, and come off again,
without losing digits. All groups but one are the total less that group's own: no model reads a row. Feature sets
that grow one upon the other are leading blocks of one matrix; its Cholesky factor serves them all. What leaves the
executors is one row of moments; models are solved for many groups at once, where the groups' rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12
#: A sum of n squares is good to about n * EPS of itself; a variance within so many times that is rounding.
EPS, ROUNDING = float(np.finfo(float).eps), 16.0


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that have a number in each of the columns."""
    has = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    return df.where(reduce(and_, has, F.lit(True)))


def ordered(sets: dict[str, list[str]]) -> list[str]:
    """All features, those of smaller sets first, so that nested sets lead."""
    return list(dict.fromkeys(f for s in sorted(sets.values(), key=len) for f in s))


def moments(df: DataFrame, groups: list[str], values: list[str], centre: dict[str, float]) -> DataFrame:
    """A row a group: n, and the sums of all products of 1 and the moved values, as an array by rows of the upper triangle."""
    moved = [F.lit(1.0), *((F.col(v).cast("double") - F.lit(float(centre[v]))) for v in values)]
    made = [F.sum(a * b) for i, a in enumerate(moved) for b in moved[i:]]
    return df.groupBy(*groups).agg(F.array(*made).alias("sums"))


def means(df: DataFrame, values: list[str]) -> dict[str, float]:
    """The overall means: one row."""
    r = df.agg(*(F.avg(F.col(v).cast("double")).alias(f"m{i}") for i, v in enumerate(values))).first()
    return {v: r[i] if r[i] is not None else 0.0 for i, v in enumerate(values)}


def unpacked(flat: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrices of rows of upper triangles."""
    out = np.zeros((len(flat), k, k))
    i, j = np.triu_indices(k)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def solved(a: np.ndarray, features: list[str], targets: list[str], sets: dict[str, list[str]], alpha: float, centre: np.ndarray, total: np.ndarray | None = None) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """(intercepts, coefficients by features) of each set and target for a stack of moment matrices; NaN where n is under 2.

    Features are standardised within the rows that a matrix sums up; one without spread gets no weight. What is left of
    a constant column by the rounding of many rows is no spread: standardised, it would correlate beyond one. total is
    the matrix that the others were taken off, with its rounding.
    """
    p = len(features)
    n = a[:, 0, 0]
    ok = n >= 2
    n1 = np.where(ok, n, 1)
    mean = a[:, 0, 1:] / n1[:, None]
    cov = a[:, 1:, 1:] / n1[:, None, None] - mean[:, :, None] * mean[:, None, :]
    var = np.einsum("gii->gi", cov)[:, :p]
    whole = a if total is None else total[None]
    noise = ROUNDING * EPS * whole[:, :1, 0] * np.einsum("gii->gi", whole)[:, 1 : p + 1] / n1[:, None]
    sd = np.sqrt(np.maximum(var, 0))
    use = (sd > TINY) & (var > noise)
    z = np.where(use, sd, 1.0)
    both = use[:, :, None] & use[:, None, :]
    gram = np.where(both, cov[:, :p, :p] / (z[:, :, None] * z[:, None, :]), 0) * n1[:, None, None]
    gram += np.eye(p) * (max(alpha, TINY) + np.where(use, 0.0, 1.0))[:, None, :]
    right = np.where(use[:, :, None], cov[:, :p, p:] / z[:, :, None], 0) * n1[:, None, None]
    factor = np.linalg.cholesky(gram)
    half = np.linalg.solve(factor, right)  # forward substitution, shared by all leading blocks
    out = {}
    for name, chosen in sets.items():
        at = [features.index(f) for f in chosen]
        w = np.zeros((len(a), p, len(targets)))
        if at == list(range(len(at))):
            k = len(at)
            w[:, :k] = np.linalg.solve(np.swapaxes(factor[:, :k, :k], 1, 2), half[:, :k])
        else:
            w[:, at] = np.linalg.solve(gram[np.ix_(range(len(a)), at, at)], right[:, at])
        w = np.where(use[:, :, None], w, 0) / z[:, :, None]
        for t, target in enumerate(targets):
            b = np.where(ok[:, None], w[:, :, t], np.nan)
            # back from moved values
            intercept = centre[p + t] + mean[:, p + t] - (b * (mean[:, :p] + centre[:p])).sum(axis=1)
            out[name, target] = (intercept, b)
    return out


def ridge_models(sums: DataFrame, keys: list[str], features: list[str], targets: list[str], sets: dict[str, list[str]], centre: dict[str, float], alpha: float = 1.0, total: np.ndarray | None = None) -> DataFrame:
    """keys, model, target, n, intercept and coefficients (by features): models of each row's moments, or of total less them."""
    k = 1 + len(features) + len(targets)
    c = np.array([centre[v] for v in [*features, *targets]])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            a = unpacked(flat if total is None else total - flat, k)
            of = None if total is None else unpacked(total[None], k)[0]
            for (model, target), (intercept, b) in solved(a, features, targets, sets, alpha, c, of).items():
                rows = batch.num_rows
                cols = [*(batch.column(x) for x in keys), pa.array([model] * rows), pa.array([target] * rows), pa.array(np.rint(a[:, 0, 0]).astype(np.int64)), pa.array(intercept, from_pandas=True)]
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(features)), pa.array(b.ravel())))
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "model", "target", "n_train", "intercept", "coefficients"])

    return sums.select(*keys, "sums").mapInArrow(run, f"{fields}, model string, target string, n_train long, intercept double, coefficients array<double>")


def left_out(df: DataFrame, group: str, features: list[str], targets: list[str], sets: dict[str, list[str]], alpha: float = 1.0, held: Column | None = None) -> DataFrame:
    """Models of each group fitted to the rows of all others; groups for which held is not true are never left out (auxiliary rows)."""
    values = [*features, *targets]
    d = complete(df, values)
    centre = means(d, values)
    sums = moments(d, [group], values, centre)
    width = (len(values) + 1) * (len(values) + 2) // 2
    whole = sums.agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width))).first()  # one row
    total = np.array([x or 0.0 for x in whole])
    kept = sums.where(F.col(group).isNotNull() if held is None else held)
    return ridge_models(kept, [group], features, targets, sets, centre, alpha, total)


def predicted(df: DataFrame, models: DataFrame, on: list[str], features: list[str], name: str = "predicted") -> DataFrame:
    """df with model, target and what the model of its keys says; without keys every row meets every model (a few rows, broadcast)."""
    m = models.select(*(F.col(c).alias(f"__of_{c}") for c in on), "model", "target", "n_train", "intercept", "coefficients")
    said = F.col("intercept") + F.aggregate(F.zip_with("coefficients", F.array(*(F.col(f).cast("double") for f in features)), lambda w, x: F.when(w == 0, 0.0).otherwise(w * x)), F.lit(0.0), lambda a, x: a + x)
    met = df.join(m, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in on]) if on else df.join(F.broadcast(m))
    return met.select(*df.columns, "model", "target", "n_train", said.alias(name))


def half_widths(errors: DataFrame, by: list[str], group: str, error: str, coverage: float, least: int) -> DataFrame:
    """by and half_width: of the groups' worst errors the ceil((n + 1) * coverage)-th smallest, infinite where there are too few."""
    worst = errors.groupBy(*by, group).agg(F.max(F.abs(F.col(error))).alias("worst"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("worst", group))
    n = F.count("*").over(Window.partitionBy(*by))
    rank = F.ceil((F.col("n") + 1) * F.lit(coverage))
    d = worst.withColumns({"place": place, "n": n})
    found = d.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.when(F.col("place") == rank, F.col("worst"))).alias("w"))
    return found.select(*by, F.when((F.col("n") >= least) & F.col("w").isNotNull(), F.col("w")).otherwise(float("inf")).alias("half_width"))
