"""Corpus scans on small trees of files."""

import json

import pytest

from pulseloom.sources import corpora as c

HEAD = "Time [sec],PPG IR [-],PPG Red [-],SBP [mmHg],DBP [mmHg],HR [bpm]\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for who, sbp in (("p1", "120"), ("p2", "bad")):
        d = root / "wrist" / who / "w1" / "s1" / "20260101"
        d.mkdir(parents=True)
        (d / "ESP_1.csv").write_text(HEAD + "".join(f"{0.02 * i},{100 + i},{90 + i},{sbp if i else '119' if who == 'p2' else sbp},80,70\n" for i in range(5)))
    (root / "wrist" / "ESP_top.csv").write_text(HEAD + "0,1,1,1,1,1\n")
    raw, labels = root / "raw", root / "labels"
    raw.mkdir()
    labels.mkdir()
    meta = lambda t, **k: (raw / f"a_b_{t}_metadata.json").write_text(json.dumps({"subject_id": "a", "session_id": "b", "trial_id": t, "ppg_profile": "arm", **k}))
    meta("t1", systolic_mmhg=120, diastolic_mmhg=80, output_csv_path="/elsewhere/named.csv")
    meta("t2", systolic_mmhg=120, diastolic_mmhg=80, output_csv_path="gone.csv")
    meta("t3", systolic_mmhg=130, diastolic_mmhg=80)
    meta("t4")
    meta("t5", systolic_mmhg=1, diastolic_mmhg=1, ppg_profile="finger")
    (raw / "named.csv").write_text("x")
    (raw / "a_b_t2_ppg.csv").write_text("x")
    (raw / "a_b_t2_imu.csv").write_text("x")
    (labels / "b_labels.csv").write_text("﻿subject,session,trial_id,sbp,dbp,omron_hr\n a ,b,t1,120.0,,71\na,b,t3,131,80,\na,b,t9,1,1,\na,b,t9,1,1,\n,b,t8,1,1,\n", encoding="utf-8")
    (root / "lines").mkdir()
    (root / "lines" / "1.txt").write_text("1.5\n2.5\nx\n4\n")
    (root / "people.csv").write_text("Table of people,,\n,,\nNum., Age ,SBP\n1,30,120\n\n2,40,130\n")
    return root


def test_wrist_tree(spark, tree):
    got = {r.participant_id: r for r in c.wrist_recordings(spark, str(tree / "wrist")).collect()}
    assert set(got) == {"p1", "p2"} and (got["p1"].session_id, got["p1"].sbp, got["p1"].n, got["p1"].fault) == ("w1_s1_20260101", 120.0, 5, "") and abs(got["p1"].sample_rate_hz - 50) < 1e-6
    assert got["p2"].sbp == 119.0 and got["p2"].fault == ""  # text is no number, and one number is left
    with pytest.raises(ValueError):
        c.wrist_recordings(spark, str(tree / "labels"), "*.csv")


def test_labels_and_local_recordings(spark, tree):
    labels = c.label_rows(spark, str(tree / "labels"))
    assert sorted((r.trial_id, r.fault) for r in labels.collect()) == [("t1", ""), ("t3", ""), ("t8", "incomplete label identity"), ("t9", "repeated label"), ("t9", "repeated label")]
    with pytest.raises(Exception, match="label"):
        c.strict(labels).collect()
    got = {r.trial_id: r for r in c.local_recordings(spark, str(tree / "raw"), labels.where("fault = ''"), "arm").collect()}
    assert set(got) == {"t1", "t2", "t3", "t4"}
    assert "no systolic pressure" in got["t4"].fault or "no diastolic pressure" in got["t4"].fault  # stays, with a fault
    assert got["t1"].ppg_path.endswith("named.csv") and got["t1"].rate == 71 and got["t1"].fault == "" and got["t1"].imu_path is None
    assert got["t2"].ppg_path.endswith("a_b_t2_ppg.csv") and got["t2"].imu_path.endswith("a_b_t2_imu.csv")
    assert got["t3"].fault == "conflicting systolic" and got["t3"].ppg_path is None
    some = spark.createDataFrame([("a", "b", "t2")], "participant_id string, session_id string, trial_id string")
    assert [r.trial_id for r in c.local_recordings(spark, str(tree / "raw"), labels, identities=some).collect()] == ["t2"]


def test_value_lines_and_strict_signals(spark, tree):
    v = c.value_lines(spark, str(tree / "lines"), 1000.0)
    assert [(r.position, r.time_s, r.value) for r in v.orderBy("position").collect()] == [(0, 0.0, 1.5), (1, 0.001, 2.5), (2, 0.002, None), (3, 0.003, 4.0)]
    assert c.strict_signal(v, ["path"], "time_s", "value").first().fault == "not finite"
    d = spark.createDataFrame([("a", i, float(i), 1.0) for i in range(5)] + [("b", i, float(i % 3), 1.0) for i in range(5)] + [("c", 0, 0.0, 1.0)], "k string, position int, t double, v double")
    assert {r.k: r.fault for r in c.strict_signal(d, ["k"], "t", "v").collect()} == {"a": "", "b": "time does not rise", "c": "too short"}


def test_header_below_other_lines(spark, tree):
    got = sorted(map(tuple, c.headed_table(spark, str(tree / "people.csv"), ["age", "SBP"]).collect()))
    assert got == [("30", "120"), ("40", "130")]
    with pytest.raises(ValueError):
        c.headed_table(spark, str(tree / "people.csv"), ["weight"])


def test_registry_and_names(spark, tree):
    wrist, gone = str(tree / "wrist"), str(tree / "nowhere")
    loaders = dict.fromkeys(("a", "b", "c", "d"), lambda s, p: c.wrist_recordings(s, p)) | {"e": lambda s, p: c.headed_table(s, f"{p}/p1/w1/s1/20260101/ESP_1.csv", ["no"])}
    sources = {"a": {"path": wrist, "enabled": True}, "b": {"path": gone, "enabled": True, "optional": True}, "c": {"path": gone, "enabled": True}, "e": {"path": wrist, "enabled": True}}
    assert {r.source: (r.status, r.n) for r in c.registry(spark, sources, loaders).collect()} == {"a": ("available", 2), "b": ("not_installed", 0), "c": ("missing_required", 0), "d": ("disabled", 0), "e": ("error", 0)}
    names = c.file_names(spark, f"{tree}/raw/*.csv", f"{tree}/raw/named*").collect()
    assert sorted((r.file, r.pattern) for r in names) == [("a_b_t2_imu.csv", 0), ("a_b_t2_ppg.csv", 0), ("named.csv", 0)]
