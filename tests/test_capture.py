"""Captures: batches that come twice or die half way, identities, and what readers see."""

import pytest
from pyspark.sql import functions as F

from pulseloom.streaming import capture as c

SCHEMA = "seq long, ir long"
WHO = {"subject": "s1", "session": "a", "trial": "t1"}


def rows(spark, a, z):
    return spark.range(a, z).select(F.col("id").alias("seq"), (F.col("id") * 2).alias("ir"))


def seqs(capture):
    return sorted((r.batch_id, r.seq) for r in capture.table().collect())


def test_a_repeated_batch_writes_nothing(spark, tmp_path):
    path = c.folder(str(tmp_path), "s1", "a", "t1")
    one = c.Capture(spark, path, WHO, SCHEMA)
    assert one.table().count() == 0 and one.add(rows(spark, 0, 5), 0) and one.add(rows(spark, 5, 8), 1)
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    assert not one.add(rows(spark, 100, 200), 1)
    assert sorted(str(p) for p in tmp_path.rglob("*")) == before
    assert seqs(one) == [(0, i) for i in range(5)] + [(1, i) for i in range(5, 8)]


def test_what_the_ledger_does_not_name_is_not_there(spark, tmp_path):
    one = c.Capture(spark, str(tmp_path / "x"), WHO, SCHEMA)
    one.add(rows(spark, 0, 3), 0)
    rows(spark, 50, 60).write.parquet(f"{one.path}/data/batch=1")  # died before it was published
    assert seqs(one) == [(0, 0), (0, 1), (0, 2)]
    assert one.add(rows(spark, 3, 4), 1) and seqs(one)[-1] == (1, 3)


def test_resume_and_refusal(spark, tmp_path):
    path = str(tmp_path / "x")
    c.Capture(spark, path, WHO, SCHEMA).add(rows(spark, 0, 2), 0)
    with pytest.raises(c.Refused, match="resume"):
        c.Capture(spark, path, WHO, SCHEMA)
    with pytest.raises(c.Refused, match="another"):
        c.Capture(spark, path, WHO | {"trial": "t2"}, SCHEMA, resume=True)
    again = c.Capture(spark, path, WHO, SCHEMA, resume=True)
    assert not again.add(rows(spark, 0, 2), 0) and again.add(rows(spark, 2, 4), 1)
    with pytest.raises(c.Refused, match="not finished"):
        c.read_capture(spark, path)
    notes = spark.createDataFrame([("rest", 0.0, 30.0)], "label string, start_s double, end_s double")
    again.finish({"note": "x"}, notes)
    assert c.read_capture(spark, path) == WHO | {"note": "x", "batches": 2, "rows": 4, "annotated": True}
    assert spark.read.option("header", "true").csv(f"{path}/annotations").collect()[0].label == "rest"
    for act in (lambda: again.finish({}), lambda: c.Capture(spark, path, WHO, SCHEMA, resume=True)):
        with pytest.raises(c.Refused, match="finished"):
            act()


@pytest.mark.parametrize("part", ["..", "a/b", "", "-x", "a" * 65, "a\n", "~"])
def test_names_that_could_leave_the_folder(part):
    with pytest.raises(c.Refused):
        c.folder("/data", "s1", part)


def test_a_stream_started_anew_does_not_repeat_itself(spark, tmp_path):
    for k in range(3):
        rows(spark, 10 * k, 10 * k + 10).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for turn in range(2):  # the second time without its checkpoint: all batches are delivered again
        one = c.Capture(spark, str(tmp_path / "out"), WHO, SCHEMA, resume=turn > 0)
        q = files.writeStream.foreachBatch(one.batches()).option("checkpointLocation", str(tmp_path / f"cp{turn}")).start()
        q.processAllAvailable()
        q.stop()
    assert [s for _, s in seqs(one)] == list(range(30)) and one.finish({})["rows"] == 30
