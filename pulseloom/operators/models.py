"""Models whose fitting is a sum over rows: ridge regression held out by group, and resampled intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .studies import ranked


def moments(df: DataFrame, group: str, features: list[str], target: str) -> DataFrame:
    """A row a group: n and the sums of all products of 1, features and target. Nothing else of the rows is needed."""
    names = ["__one", *features, target]
    d = df.withColumn("__one", F.lit(1.0))
    made = [F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return d.groupBy(group).agg(*made)


def ridge_left_out(df: DataFrame, group: str, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """A row a group: intercept and coefficients of the ridge fit to all other groups, features standardised there.

    The groups' moments are summed once; each group's own are taken off again. One small matrix a group.
    """
    m = moments(df, group, features, target)
    sums = [c for c in m.columns if c != group]
    total = m.agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    k = len(features) + 2
    fields = ", ".join(f"b_{f} double" for f in features)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pandas()
            rows = []
            for r in d.itertuples(index=False):
                a = np.zeros((k, k))
                at = iter(range(len(sums)))
                for i in range(k):
                    for j in range(i, k):
                        c = next(at)
                        a[i, j] = a[j, i] = r[1 + len(sums) + c] - r[1 + c]
                n = a[0, 0]
                if n <= 1:
                    rows.append((r[0], n, np.nan, *[np.nan] * (k - 2)))
                    continue
                mean = a[0, 1:] / n
                cov = a[1:, 1:] / n - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
                use = sd > 1e-12
                z = np.where(use, sd, 1)
                g = cov[:-1, :-1] / np.outer(z, z) * n + alpha * np.eye(k - 2)
                w = np.where(use, np.linalg.solve(g, cov[:-1, -1] / z * n), 0) / z
                rows.append((r[0], n, mean[-1] - w @ mean[:-1], *w))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[group, "n_train", "intercept", *[f"b_{f}" for f in features]]), preserve_index=False)

    kind = dict(df.dtypes)[group]
    return m.crossJoin(F.broadcast(total)).select(group, *sums, *[f"t_{c}" for c in sums]).mapInArrow(solve, f"{group} {kind}, n_train double, intercept double, {fields}")


def bootstrap_mean(df: DataFrame, group: str, value: str, draws: int = 200, seed: int = 11) -> DataFrame:
    """Mean of value with its 2.5 and 97.5 percentiles over draws that take as many whole groups as there are, with replacement.

    The groups' sums are numbered; a draw's j-th pick is a digest of (seed, draw, j), so that reruns agree and
    no group's rows, and no draw's picks, are gathered: picks stream past a hash table of a part of the groups' sums.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = ranked(df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("c")), F.col(group), partitions=max(16, parts))
    n = g.agg(F.count("*").alias("n"))  # one row
    picked = g.select(F.col("rank").alias("j")).crossJoin(F.broadcast(n)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("draw").cast("string"), F.col("j").cast("string")).cast("binary"))
    picked = picked.select("draw", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("n")).alias("rank"))
    means = picked.join(g.select("rank", "s", "c").hint("shuffle_hash"), "rank").groupBy("draw").agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("m"))
    span = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return g.agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("mean"), F.count("*").alias("groups")).crossJoin(F.broadcast(span))
