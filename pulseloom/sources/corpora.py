"""Recording corpora as tables: wrist CSV trees, local JSON metadata with labels, value-a-line texts, and their registry.

Every scan is one Spark read; a file's faults are a column of its row, so that one bad file does not hide the
others, and strict() turns them into an error where a caller wants that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import median, ratio

WRIST = {"time_s": "Time [sec]", "ir": "PPG IR [-]", "red": "PPG Red [-]", "sbp": "SBP [mmHg]", "dbp": "DBP [mmHg]", "hr": "HR [bpm]"}
IDENTITY = ["participant_id", "session_id", "trial_id"]


def file_names(spark: SparkSession, *patterns: str) -> DataFrame:
    """path and file of all that the patterns match, once each, in the order of the first pattern that does. No content is read."""
    made = None
    for i, p in enumerate(patterns):
        d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", F.lit(i).alias("pattern"))
        made = d if made is None else made.unionByName(d)
    first = made.groupBy("path").agg(F.min("pattern").alias("pattern"))
    return first.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "pattern")


def strict(df: DataFrame, fault: str = "fault") -> DataFrame:
    """df without its column of faults; the first fault that is met stops the job."""
    return df.where(F.when(F.col(fault) != "", F.raise_error(F.col(fault))).otherwise(F.lit(True))).drop(fault)


def wrist_recordings(spark: SparkSession, root: str, pattern: str = "ESP*.csv") -> DataFrame:
    """A row for each file five levels below root: identity from its folders, rate, and labels that must be constant."""
    raw = spark.read.csv(root, header=True, recursiveFileLookup=True, pathGlobFilter=pattern).withColumn("path", F.col("_metadata.file_path"))
    lacking = [c for c in WRIST.values() if c not in raw.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    rows = raw.select("path", *[number(c).alias(k) for k, c in WRIST.items()])
    step = F.col("time_s") - F.lag("time_s").over(Window.partitionBy("path").orderBy("time_s"))
    g = rows.withColumn("step", step).groupBy("path").agg(F.count("*").alias("n"), ratio(F.lit(1.0), median(F.when(F.col("step") > 0, F.col("step")))).alias("sample_rate_hz"), *[F.collect_set(c).alias(c) for c in ("sbp", "dbp", "hr")])
    part = F.split(F.regexp_replace("path", f"^.*?{root.rstrip('/').split('/')[-1]}/", ""), "/")
    fault = F.array_join(F.array_compact(F.array(*[F.when(F.size(c) != 1, f"not one constant {c}") for c in ("sbp", "dbp", "hr")])), ";")
    named = g.where(F.size(part) >= 5).withColumn("__part", part)
    at = lambda i: F.get("__part", F.lit(i))
    return named.select(
        at(0).alias("participant_id"), F.concat_ws("_", at(1), at(2), at(3)).alias("session_id"), at(3).alias("chronological_order"), "n", "sample_rate_hz",
        *[F.when(F.size(c) == 1, F.get(c, F.lit(0))).alias(c) for c in ("sbp", "dbp", "hr")], "path", fault.alias("fault"),
    )


def label_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all *_labels.csv: trimmed identity, the other columns as text, and a fault where it is incomplete or repeated."""
    raw = spark.read.csv(folder, header=True, pathGlobFilter="*_labels.csv")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    named = raw.select(t("subject").alias("participant_id"), t("session").alias("session_id"), t("trial_id").alias("trial_id"), *[F.col(c) for c in raw.columns if c not in ("subject", "session", "trial_id")])
    blank = (F.col("participant_id") == "") | (F.col("session_id") == "") | (F.col("trial_id") == "")
    n = F.count(F.lit(1)).over(Window.partitionBy(*IDENTITY))
    return named.withColumn("fault", F.when(blank, "incomplete label identity").when(n > 1, "repeated label").otherwise(""))


def _merged(metadata: Column, label: Column) -> Column:
    return F.when(F.trim(F.coalesce(label, F.lit(""))) != "", label).otherwise(metadata)


def local_recordings(spark: SparkSession, raw_dir: str, labels: DataFrame, profile: str | None = None, identities: DataFrame | None = None) -> DataFrame:
    """Recordings of *_metadata.json, their labels merged in, and the signal files that there are; without both pressures, with a fault.

    profile filters by ppg_profile, identities (IDENTITY columns) are a semi-join. A signal file is the one that the
    metadata name, if it is there, else the one of the metadata's own name. A label that contradicts is a fault.
    """
    kind = "subject_id string, session_id string, trial_id string, ppg_profile string, systolic_mmhg string, diastolic_mmhg string, cuff_hr_bpm string, output_csv_path string, recording_start_time string, timing_quality string"
    m = spark.read.json(raw_dir, schema=kind, multiLine=True, pathGlobFilter="*_metadata.json").withColumn("file", F.col("_metadata.file_name"))
    m = m.where(F.col("ppg_profile") == profile) if profile else m
    m = m.withColumnRenamed("subject_id", "participant_id")
    for c in IDENTITY:
        m = m.withColumn(c, F.trim(F.coalesce(c, F.lit("")))).where(F.col(c) != "")
    if identities is not None:
        m = m.join(identities.select(*IDENTITY), IDENTITY, "left_semi")
    both = m.join(labels.select(*IDENTITY, "sbp", "dbp", "omron_hr", F.col("fault").alias("label_fault")), IDENTITY, "left")
    pairs = {"systolic": ("systolic_mmhg", "sbp"), "diastolic": ("diastolic_mmhg", "dbp"), "rate": ("cuff_hr_bpm", "omron_hr")}
    wrong = [F.when(~R.values_agree(F.col(a), F.col(b)), f"conflicting {k}") for k, (a, b) in pairs.items()]
    lacking = [F.when(_merged(F.col(a), F.col(b)).try_cast("double").isNull(), f"no {k} pressure") for k, (a, b) in pairs.items() if k != "rate"]
    named = both.select(
        *IDENTITY, *[_merged(F.col(a), F.col(b)).try_cast("double").alias(k) for k, (a, b) in pairs.items()], F.coalesce("recording_start_time", F.concat_ws(":", "session_id", "trial_id")).alias("chronological_order"),
        F.array_join(F.array_compact(F.array(F.when(F.col("label_fault") != "", F.col("label_fault")), *wrong, *lacking)), ";").alias("fault"),
        F.regexp_extract(F.coalesce("output_csv_path", F.lit("")), "([^/]*)$", 1).alias("given"), F.regexp_replace("file", "_metadata[.]json$", "_ppg.csv").alias("own"), F.regexp_replace("file", "_metadata[.]json$", "_imu.csv").alias("imu_own"),
    )
    files = file_names(spark, raw_dir).select("path", "file")
    found = lambda c: files.select(F.col("file").alias(c), F.col("path").alias(f"{c}_path"))
    d = named.join(found("given"), "given", "left").join(found("own"), "own", "left").join(found("imu_own"), "imu_own", "left")
    return d.select(*IDENTITY, *pairs, "chronological_order", F.coalesce("given_path", "own_path").alias("ppg_path"), F.col("imu_own_path").alias("imu_path"), "fault")


def value_lines(spark: SparkSession, folder: str, rate: float, pattern: str = "*.txt") -> DataFrame:
    """path, position, time_s and value of texts with one value on a line; a line that is no number has a null value."""
    text = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\s+")).alias("position", "part"))
    return text.where("part <> ''").select("path", "position", (F.col("position") / rate).alias("time_s"), F.col("part").try_cast("double").alias("value"))


def headed_table(spark: SparkSession, path: str, needed: list[str], within: int = 20) -> DataFrame:
    """The rows below the first of the leading lines that has all needed column names (any case), as text columns."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    cells = lines.select("n", F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("c"))
    lower = F.transform("c", F.lower)
    head = cells.where((F.col("n") < within) & F.forall(F.array(*map(F.lit, needed)), lambda x: F.array_contains(lower, F.lower(x)))).orderBy("n").limit(1).select(F.col("n").alias("head"), lower.alias("names"))
    if head.isEmpty():
        raise ValueError(f"no header with {', '.join(needed)} in the first {within} lines")
    rows = cells.crossJoin(F.broadcast(head)).where((F.col("n") > F.col("head")) & (F.array_join("c", "") != ""))
    return rows.select(*[F.get("c", (F.array_position("names", c.lower()) - 1).cast("int")).alias(c) for c in needed])


def strict_signal(df: DataFrame, keys: list[str], time: str, value: str, least: int = 4) -> DataFrame:
    """A row a signal with its fault: too short, not finite, or times that do not rise in the order of position."""
    w = Window.partitionBy(*keys).orderBy("position")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    d = df.withColumn("__step", F.col(time) - F.lag(time).over(w))
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(bad(time) | bad(value)).alias("odd"), F.count_if(F.col("__step") <= 0).alias("back"))
    return g.select(*keys, "n", F.when(F.col("n") < least, "too short").when(F.col("odd") > 0, "not finite").when(F.col("back") > 0, "time does not rise").otherwise("").alias("fault"))


def registry(spark: SparkSession, sources: dict[str, dict], loaders: dict[str, Callable[[SparkSession, str], DataFrame]]) -> DataFrame:
    """source, status, n and error of each loader: disabled, not_installed, missing_required, available or error.

    sources: path, enabled and optional of each. A source that fails leaves the others alone.
    """
    rows = []
    for name, load in loaders.items():  # a few sources, never rows
        s = sources.get(name, {})
        if not s.get("enabled", False):
            rows.append((name, "disabled", 0, None))
            continue
        try:
            file_names(spark, s["path"]).isEmpty()
        except AnalysisException:
            rows.append((name, "not_installed" if s.get("optional", False) else "missing_required", 0, None))
            continue
        try:
            rows.append((name, "available", load(spark, s["path"]).count(), None))
        except Exception as e:
            rows.append((name, "error", 0, str(e).split("\n")[0][:200]))
    return spark.createDataFrame(rows, "source string, status string, n long, error string")
