"""Shadow scores: a frozen classifier beside live windows, which says what it would say and changes nothing.

A package is one JSON text: features in order with their means and scales, weights, an intercept, the threshold, the
classes (0 usable, 1 unusable) and the digest of the configuration it was made under. Whatever does not fit is refused
before a row is scored. Its numbers become literals of a column expression, so that scoring is part of the plan, on
streams and tables alike, and nothing is sent to the executors but the plan.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("model_name", "feature_columns", "means", "scales", "weights", "intercept", "decision_threshold", "classes", "config_sha256")
REASON = "shadow prediction only; nothing else changes"


class Refused(ValueError):
    """A package that cannot be trusted."""


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Package:
    name: str
    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    threshold: float
    sha256: str


def frozen(name: str, features: list[str], means: list[float], scales: list[float], weights: list[float], intercept: float, threshold: float, config: str) -> str:
    """The text of a package made under a configuration."""
    return json.dumps(dict(zip(REQUIRED, (name, features, means, scales, weights, intercept, threshold, [0, 1], digest(config)), strict=True)), sort_keys=True)


def opened(text: str, config: str, sha256: str | None = None) -> Package:
    """A package's text, checked against the configuration in use and, if given, the digest that was published for it."""
    own = digest(text)
    if sha256 is not None and own != sha256:
        raise Refused("the package is not the one that was published")
    try:
        p = json.loads(text)
    except ValueError as e:
        raise Refused(f"the package cannot be read: {e}") from e
    if not isinstance(p, dict):
        raise Refused("a package is a dictionary")
    if missing := sorted(set(REQUIRED) - set(p)):
        raise Refused("missing: " + ", ".join(missing))
    if p["config_sha256"] != digest(config):
        raise Refused("the package was made under another configuration")
    if p["classes"] != [0, 1]:
        raise Refused("classes must be usable 0, unusable 1")
    n = len(p["feature_columns"])
    if not n or len(set(p["feature_columns"])) != n or any(len(p[k]) != n for k in ("means", "scales", "weights")):
        raise Refused("features, means, scales and weights must have one length, and names must differ")
    numbers = [*p["means"], *p["scales"], *p["weights"], p["intercept"], p["decision_threshold"]]
    if not all(isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) for x in numbers) or min(p["scales"]) <= 0:
        raise Refused("numbers must be finite and scales positive")
    if not 0 <= p["decision_threshold"] <= 1:
        raise Refused("the threshold must lie between 0 and 1")
    return Package(str(p["model_name"]), tuple(map(str, p["feature_columns"])), *(tuple(map(float, p[k])) for k in ("means", "scales", "weights")), float(p["intercept"]), float(p["decision_threshold"]), own)


def probability(package: Package) -> Column:
    """Of the class unusable; null where a feature is missing or not finite."""
    z, fit = F.lit(package.intercept), F.lit(True)
    for f, m, s, w in zip(package.features, package.means, package.scales, package.weights, strict=True):
        x = F.col(f).cast("double")
        z = z + (x - F.lit(m)) / F.lit(s) * F.lit(w)
        fit = fit & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(fit, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def shadowed(windows: DataFrame, package: Package, started_us: Column | None = None, health: str | None = None) -> DataFrame:
    """The seventeen columns of a shadow record for each window (device, start_us, end_us, counts, completeness, reasons, features).

    A window with reasons against it is not scored, nor is one whose device has a health fault (a column of texts, null
    where there is none), nor one that lacks a feature; the status says which.
    """
    if missing := [f for f in package.features if f not in windows.columns]:
        raise Refused("the windows lack " + ", ".join(missing))
    p = F.round(probability(package), 6)
    ill = F.col(health).isNotNull() if health else F.lit(False)
    refused = F.coalesce(F.col("reasons") != "", F.lit(True))
    d = windows.withColumn("__p", F.when(~ill & ~refused, p))
    some = F.col("__p").isNotNull()
    said = F.when(some, F.when(F.col("__p") >= package.threshold, "unusable").otherwise("usable"))
    status = F.when(ill, "invalid_health").when(refused, "invalid_window").otherwise(F.coalesce(said, F.lit("analysis_error")))
    why = F.when(ill, F.concat(F.lit("sensor health fault: "), F.col(health) if health else F.lit(""))).when(refused, F.coalesce(F.nullif(F.col("reasons"), F.lit("")), F.lit("window without a verdict")))
    since = F.col("end_us") - (started_us if started_us is not None else F.lit(0))
    return d.select(
        "device", F.round(F.greatest(since, F.lit(0)) / 1e6, 3).alias("elapsed_s"), (F.col("start_us") / 1000.0).alias("window_start_timestamp_ms"), (F.col("end_us") / 1000.0).alias("window_end_timestamp_ms"),
        said.alias("prediction"), (said == "usable").alias("usable"), F.col("__p").alias("unusable_probability"), F.lit(package.threshold).alias("decision_threshold"), status.alias("status"),
        why.otherwise(F.when(some, REASON).otherwise("a feature is missing or not finite")).alias("reason"), F.col("ppg_samples").alias("ppg_sample_count"), F.col("imu_samples").alias("imu_sample_count"),
        *(F.round(c, 6).alias(c) for c in ("ppg_completeness", "imu_completeness")), F.lit(package.name).alias("model_name"), F.lit(package.sha256).alias("model_sha256"), F.lit(True).alias("shadow_mode"), F.lit(False).alias("affects_bp_or_hr"),
    )
