"""The gates of a trial's consensus, one by one."""

import pytest

from pulseloom.operators.consensus import Gates, consensus

SCHEMA = "trial string, start_s long, end_s long, status string, bpm double"


def windows(trial, bpms, step=5, status="accepted"):
    return [(trial, step * i, step * i + 20, status, b) for i, b in enumerate(bpms)]


def test_each_gate(spark):
    rows = [
        *windows("good", [70.0, 71.0, 70.5, 90.0]),
        *windows("few", [70.0, 70.0]),
        *windows("short", [70.0, 70.0, 70.0], step=1),
        *windows("split", [70.0, 70.5, 90.0, 90.5]),
        *windows("led", [70.0, 70.1, 70.2, 90.0, 90.1]),
        *windows("rising", [66.0, 67.0, 68.0, 69.0, 70.0]),
        *windows("same", [70.0, 70.0, 70.0, 70.0]),
        *windows("moved", [None] * 4, status="motion_contaminated"), ("moved", 0, 20, "poor_contact", None),
        *windows("loose", [None] * 2, status="poor_contact"),
        *windows("poor", [None] * 2, status="poor_waveform_quality"),
        *windows("nothing", [None], status="edge_guard"),
    ]
    got = {r.trial: r for r in consensus(spark.createDataFrame(rows, SCHEMA), ["trial"]).collect()}
    status = {k: r.status for k, r in got.items()}
    assert status == {
        "good": "usable", "few": "insufficient_clean_data", "short": "insufficient_clean_data", "split": "ambiguous_hr", "led": "ambiguous_hr", "rising": "ambiguous_hr", "same": "usable",
        "moved": "motion_contaminated", "loose": "contact_artifact", "poor": "poor_waveform_quality", "nothing": "insufficient_clean_data",
    }
    assert (got["good"].bpm, got["good"].winners, got["good"].runner_up, got["good"].coverage_s) == (70.5, 3, 1, 35)
    assert got["rising"].trend == pytest.approx(0.2) and got["rising"].reason == "the rate changes too quickly" and got["led"].reason == "no cluster is well ahead"
    assert got["same"].bpm == 70.0 and got["same"].trend == 0 and all(r.bpm is None for r in got.values() if r.status != "usable")


def test_gates_are_parameters(spark):
    df = spark.createDataFrame(windows("led", [70.0, 70.1, 70.2, 90.0, 90.1]), SCHEMA)
    assert consensus(df, ["trial"], Gates(lead=1.5)).first().status == "usable"
    assert consensus(df, ["trial"], Gates(lead=1.5, windows=6)).first().status == "insufficient_clean_data"
    assert consensus(df, ["trial"], Gates(lead=1.5, share=0.61)).first().status == "ambiguous_hr"
    assert consensus(df.limit(0), ["trial"]).collect() == []
