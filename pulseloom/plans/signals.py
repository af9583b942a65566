"""Queries of the signal kernels. embeddings stand for windows of 64 samples at 16 Hz, a label's vectors for a recording."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rates, waves
from ..operators import series as se
from .catalogue import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RATE = 16.0
#: Vectors of a recording are looked through in ranges of so many ids.
RANGE = 4096


def query(f):
    QUERIES[f.__name__] = f
    return f


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two vectors of a recording, hopping by one: start_id, label and 128 samples; the last vector has none."""
    e = read(spark, sf_dir, "embeddings").where("embedding is not null").withColumn("range", se.block_of(F.col("vec_id"), RANGE))
    e = se.followed(e, ["label"], "vec_id", "range", "embedding", "next").select("vec_id", "label", "embedding", "next")
    return e.where(F.col("next").isNotNull() & (F.size("embedding") == 64) & (F.size("next") == 64)).select("vec_id", "label", F.concat("embedding", "next").alias("samples"))


def over_matrix(rows: DataFrame, column: str, made: dict[str, str], f: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """rows without column, with the columns made (name: type) of f over the matrix of each batch; rows are windows of one length."""
    keep = [c for c in rows.columns if c != column]
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep), *(f"{k} {t}" for k, t in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                flat = part.column(len(keep))
                x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                got = f(x)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(got[k], from_pandas=True) for k in made)], names=[*keep, *made])

    return rows.select(*keep, column).mapInArrow(run, schema)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def optical(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as two optical channels in counts and three axes in g."""
    axes = np.stack([0.1 * x, 0.1 * np.roll(x, 5, axis=1), 1 + 0.1 * np.roll(x, 11, axis=1)], axis=2)
    return 60_000 + 4000 * x, 50_000 + 2500 * np.roll(x, 1, axis=1), axes


FEATURES = list(waves.synchronized(np.zeros((1, 128)) + np.sin(np.arange(128)), np.ones((1, 128)) + np.cos(np.arange(128)), np.ones((1, 128, 3)) * np.sin(np.arange(128))[:, None], RATE))


@query
def synchronized_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synchronized optical and motion features of every window."""
    return _rounded(over_matrix(windows(spark, sf_dir), "samples", dict.fromkeys(FEATURES, "double"), lambda x: waves.synchronized(*optical(x), RATE)))


@query
def beat_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen beat features of the better polarity, as medians over a window's beats."""
    made = {"sign": "int", "n_beats": "int", "bpm": "double", "interval_cv": "double", "template_correlation": "double", "rejection": "string", **dict.fromkeys(waves.BEAT_FEATURES, "double")}

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        b = waves.morphologies(waves.zero_phase(x, waves.band_pass(4, 0.5, 7.2, RATE)), RATE)
        out = {"sign": b["sign"].astype(np.int32), "n_beats": b["beats"].astype(np.int32), "bpm": b["bpm"], "interval_cv": b["cv"], "template_correlation": b["agreement"], "rejection": b["rejection"]}
        return out | {k: b["features"][:, i] for i, k in enumerate(waves.BEAT_FEATURES)}

    return _rounded(over_matrix(windows(spark, sf_dir), "samples", made, f))


def pulse_band(x: np.ndarray) -> np.ndarray:
    return waves.zero_phase(x, waves.band_pass(4, 0.7, 3.0, RATE))


@query
def window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's rate by three methods behind five gates, with the reasons against it."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        return dict(zip(("bpm", "reasons"), rates.by_agreement(pulse_band(x), RATE), strict=True))

    return over_matrix(windows(spark, sf_dir), "samples", {"bpm": "double", "reasons": "string"}, f)


@query
def estimator_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows under every estimator named: what each says, and whether the two live ones agree."""
    estimators = {"original": rates.by_agreement, "guided": rates.guided}

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        y, out = pulse_band(x), {}
        for name, estimator in estimators.items():
            out[name], out[f"{name}_reasons"] = estimator(y, RATE)
        return out | dict(zip(("finger", "n_peaks"), rates.finger(60_000 + 4000 * x, RATE), strict=True))

    d = over_matrix(windows(spark, sf_dir), "samples", {"original": "double", "guided": "double", "finger": "double", "n_peaks": "int", "guided_reasons": "string"}, f)
    return d.withColumn("agree", F.abs(F.col("original") - F.col("guided")) <= 6)


@query
def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every recording with admission first: only those without clipped, flat or stepping samples are computed."""
    w = windows(spark, sf_dir).withColumns({"top": F.array_max("samples"), "low": F.array_min("samples")})
    step = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(127)), lambda i: F.abs(F.get("samples", i) - F.get("samples", i - 1))))
    why = F.when(F.col("top") - F.col("low") <= 1e-9, "flat").when((F.col("top") > 0.6) | (F.col("low") < -0.6), "clipping").when(step > 0.55, "contact_step").otherwise("")
    w = w.select("vec_id", "label", why.alias("rejection"), "samples")
    names = ["bpm", "template_correlation", "rise_time_s", "width_50_phase", "area_ratio"]
    at = [waves.BEAT_FEATURES.index(n) for n in names[2:]]

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        b = waves.morphologies(waves.zero_phase(x, waves.band_pass(4, 0.5, 7.2, RATE)), RATE)
        return dict(zip(names, [b["bpm"], b["agreement"], *b["features"][:, at].T], strict=True)) | {"morphology": b["rejection"]}

    made = {**dict.fromkeys(names, "double"), "morphology": "string"}
    done = over_matrix(w.where("rejection = ''"), "samples", made, f)
    odd = read(spark, sf_dir, "embeddings").where("embedding is null or size(embedding) <> 64").select("vec_id", "label", F.lit("wrong_length").alias("rejection"))
    refused = w.where("rejection <> ''").select("vec_id", "label", "rejection").unionByName(odd).select("*", *[F.lit(None).cast(t).alias(n) for n, t in made.items()])
    both = _rounded(done).unionByName(refused)
    return both.withColumn("rejection", F.when(F.col("rejection") == "", F.col("morphology")).otherwise(F.col("rejection"))).withColumn("accepted", F.col("rejection") == "").drop("morphology")


@query
def resampled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at 25/16 of their rate: length, energy and ends."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        y = np.array([waves.resampled(w, 25, 16) for w in x])
        return {"n": np.full(len(y), y.shape[1], np.int32), "energy": (y**2).mean(axis=1), "middle": y[:, y.shape[1] // 2]}

    return _rounded(over_matrix(windows(spark, sf_dir), "samples", {"n": "int", "energy": "double", "middle": "double"}, f))


@query
def pressure_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systolic and diastolic medians of windows read as a continuous pressure wave."""

    def f(x: np.ndarray) -> dict[str, np.ndarray]:
        got = [waves.pressure_reference(w, RATE) for w in 90 + 120 * x]
        return {"systolic": np.array([np.nan if s is None else s for s, _, _ in got]), "diastolic": np.array([np.nan if d is None else d for _, d, _ in got]), "beats": np.array([n for *_, n in got], np.int32)}

    return _rounded(over_matrix(windows(spark, sf_dir), "samples", {"systolic": "double", "diastolic": "double", "beats": "int"}, f))
