"""Shadow scores: packages that are refused, scores by hand, and the stream against the table."""

import json
import math
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from pulseloom.streaming import shadow
from pulseloom.streaming.paired import Rules, checked_windows

CONFIG = '{"window_seconds": 8}'
TEXT = shadow.frozen("m", ["a", "b"], [1.0, 2.0], [2.0, 0.5], [0.5, -1.0], 0.1, 0.6, CONFIG)


def changed(**by):
    return json.dumps(json.loads(TEXT) | by)


@pytest.mark.parametrize(
    ("text", "why"),
    [
        ("{", "cannot be read"), ("[1]", "dictionary"), (json.dumps({k: v for k, v in json.loads(TEXT).items() if k != "weights"}), "missing: weights"), (changed(config_sha256="0"), "another configuration"),
        (changed(classes=[1, 0]), "classes"), (changed(feature_columns=[]), "length"), (changed(feature_columns=["a", "a"]), "length"), (changed(weights=[1.0]), "length"),
        (changed(scales=[0.0, 1.0]), "positive"), (changed(intercept=None), "finite"), (TEXT.replace("0.1", "NaN"), "finite"), (changed(decision_threshold=1.5), "between"),
    ],
)
def test_packages_that_do_not_fit_are_refused(text, why):
    with pytest.raises(shadow.Refused, match=why):
        shadow.opened(text, CONFIG)


def test_a_changed_package_is_not_the_published_one():
    sha = shadow.digest(TEXT)
    assert shadow.opened(TEXT, CONFIG, sha).sha256 == sha
    with pytest.raises(shadow.Refused, match="published"):
        shadow.opened(changed(intercept=0.2), CONFIG, sha)


def test_scores_statuses_and_columns(spark):
    package = shadow.opened(TEXT, CONFIG)
    rows = [(1, 0, 8_000_000, 9, 8, 1.0, 0.9, "", 1.0, 2.0, None), (2, 0, 8_000_000, 9, 8, 1.0, 0.9, "", 3.0, 1.0, None), (3, 0, 8_000_000, 9, 8, 1.0, 0.9, "ppg_timestamp_gap", 3.0, 1.0, None), (4, 0, 8_000_000, 9, 8, 1.0, 0.9, "", None, 1.0, None), (5, 0, 8_000_000, 9, 8, 1.0, 0.9, "", float("inf"), 1.0, None), (6, 0, 8_000_000, 9, 8, 1.0, 0.9, "", 3.0, 1.0, "stats.ovf=1"), (7, 0, 8_000_000, 9, 8, 1.0, 0.9, None, 3.0, 1.0, None)]
    w = spark.createDataFrame(rows, "device long, start_us long, end_us long, ppg_samples long, imu_samples long, ppg_completeness double, imu_completeness double, reasons string, a double, b double, fault string")
    out = shadow.shadowed(w, package, F.lit(2_000_000), "fault")
    got = {r.device: r for r in out.collect()}
    assert len(out.columns) == 18  # the device and seventeen columns
    p = 1 / (1 + math.exp(-(0.1 + (3 - 1) / 2 * 0.5 + (1 - 2) / 0.5 * -1)))
    assert (got[1].unusable_probability, got[1].prediction, got[1].usable) == (round(1 / (1 + math.exp(-0.1)), 6), "usable", True)
    assert (got[2].unusable_probability, got[2].prediction, got[2].status) == (round(p, 6), "unusable", "unusable")
    assert [got[i].status for i in range(3, 8)] == ["invalid_window", "analysis_error", "analysis_error", "invalid_health", "invalid_window"]
    assert all(got[i].unusable_probability is None and got[i].prediction is None for i in range(3, 8))
    assert got[6].reason.endswith("stats.ovf=1") and got[3].reason == "ppg_timestamp_gap" and got[1].elapsed_s == 6.0 and got[1].model_sha256 == package.sha256
    with pytest.raises(shadow.Refused, match="lack"):
        shadow.shadowed(w.drop("b"), package)


def test_scores_on_a_stream_equal_those_on_the_table(spark, tmp_path):
    from test_paired import MOTION, OPTICAL, T0, samples

    rules = Rules(width=800, step=400, late=200, completeness=0.9)
    text = shadow.frozen("m", ["ppg_completeness", "mean_ir"], [1.0, 50.0], [0.1, 10.0], [-1.0, 0.7], 0.0, 0.5, CONFIG)

    def scored(o, m):
        w = checked_windows(o, m, rules)
        mean = F.aggregate(F.transform("samples", lambda s: s["ir"]), F.lit(0.0), lambda a, x: a + x) / F.size("samples")
        return shadow.shadowed(w.withColumn("mean_ir", mean), shadow.opened(text, CONFIG))

    optical, motion = samples()
    end = T0 + timedelta(seconds=1000)
    more = {"o": (99, end, 0, 0.0, 0.0), "m": (99, end, 0, 0.0, 0.0, 0.0)}
    for name, rows, schema in (("o", optical, OPTICAL), ("m", motion, MOTION)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / "part=0"))
        spark.createDataFrame([more[name]], schema).coalesce(1).write.parquet(str(tmp_path / name / "part=1"))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
    q = scored(read("o", OPTICAL), read("m", MOTION)).writeStream.format("memory").queryName("shadow_live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("shadow_live").where("device < 99").collect()))
    assert got == sorted(map(tuple, scored(spark.createDataFrame(optical, OPTICAL), spark.createDataFrame(motion, MOTION)).collect()))
    assert {r[4] for r in got} & {"usable", "unusable"} and None in {r[4] for r in got}
