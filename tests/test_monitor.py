"""Measured jobs and the progress of streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import metrics
from quillspark.streaming import monitor


def noop(frame):
    frame.write.format("noop").mode("overwrite").save()


def test_recorder(spark, tmp_path):
    watch = monitor.Recorder(spark)
    frame = spark.range(100)
    assert watch.run("count", frame.where("id % 3 = 0"), lambda f: f.count(), odd=F.sum(F.col("id") % 2)) == 34
    watch.measured("square", noop)(lambda n: frame.select(F.col("id") * n))(2)
    with pytest.raises(Exception, match="broken"):
        watch.run("fails", frame.select(F.raise_error(F.lit("broken"))), noop)
    found = {r.op: r for r in watch.frame().collect()}
    assert (found["count"].rows, found["count"].counts) == (34, '{"odd": 17}') and found["square"].rows == 100
    assert not found["fails"].success and "broken" in found["fails"].error and found["fails"].rows is None
    assert all(r.duration > 0 for r in found.values()) and sorted(r.seq for r in found.values()) == [0, 1, 2]
    totals = {r.op: r for r in metrics.operation_metrics(watch.frame()).collect()}
    assert set(totals) == {"count", "square", "fails"}
    watch.flush(str(tmp_path / "log"))
    watch.flush(str(tmp_path / "log"))
    watch.run("later", frame, noop)
    watch.flush(str(tmp_path / "log"))
    assert sorted(r.op for r in monitor.read_events(spark, str(tmp_path / "log")).collect()) == ["count", "fails", "later", "square"]


def test_progress(spark, tmp_path):
    spark.range(90).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = []
    found = monitor.run_with_progress(stream(), "ninety", 90, lambda batch, _: noop(batch), str(tmp_path / "a"), lambda *x: told.append(x))
    assert [x[0] for x in told] == sorted(x[0] for x in told) and told[-1] == (90, 90, "ninety") and found.finished == {"ninety": None}
    assert found.frame(spark).agg(F.max("share"), F.max("done")).first()[:] == (1.0, 90)
    unknown = monitor.run_with_progress(stream(), "unknown", None, lambda batch, _: noop(batch), str(tmp_path / "b"))
    assert unknown.done["unknown"] == 90 and all(r.share is None for r in unknown.frame(spark).collect())


def test_progress_of_a_stream_that_fails(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))

    def broken(batch, number):
        raise ValueError("no disk")

    with pytest.raises(Exception, match="no disk"):
        monitor.run_with_progress(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), "broken", 10, broken, str(tmp_path / "c"))
