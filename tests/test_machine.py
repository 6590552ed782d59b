"""The job machine: stream against fold, by example and with late, repeated and conflicting messages."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from quillspark.streaming import machine

START = datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def message(job, seq, minutes, action, status=None, progress=None, text=None, error=None):
    return (job, seq, START + timedelta(minutes=minutes), action, status, progress, text, error)


def steps(spark, rows, **options):
    return machine.fold_messages(spark.createDataFrame(rows, machine.MESSAGE), **options)


def test_transitions(spark):
    rows = [
        message("a", 1, 0, "create"), message("a", 2, 1, "create"), message("a", 3, 2, "update", "processing", 0.25, "page 1"), message("a", 3, 2, "update", "processing", 0.25, "page 1"),
        message("a", 4, 3, "update", None, 7.0), message("a", 5, 4, "delete"), message("a", 6, 5, "update", "failed", error="late"), message("a", 7, 6, "update", "processing"),
        message("a", 8, 7, "retry"), message("a", 9, 7, "retry"), message("a-retry-1", 1, 8, "cancel"), message("a-retry-2", 1, 9, "update", "processing", -1.0), message("a", 10, 10, "fly"), message("a", 11, 5000, "retry"), message("b", 1, 0, "cancel"), message(None, 1, 0, "create"),
    ]
    found = steps(spark, rows)
    got = {(r.job_id, r.seq): r for r in found.where("action <> 'expired'").collect()}
    assert len(got) == 14
    assert got["a", 3].started_at == START + timedelta(minutes=2) and got["a", 3].progress == 0.25 and got["a", 4].progress == 1.0
    assert got["a", 5].problem == "cannot delete a job that is processing" and got["a", 2].problem == "already there"
    assert got["a", 6].status == "failed" and got["a", 6].completed_at == START + timedelta(minutes=5) and got["a", 6].error == "late"
    assert got["a", 7].problem == "cannot update a job that is failed" and got["a", 10].problem == "cannot fly a job that is failed"
    assert [got["a", k].new_job_id for k in (8, 9)] == ["a-retry-1", "a-retry-2"]
    assert got["a-retry-1", 1].status == "cancelled" and got["a-retry-2", 1].progress == 0.0
    assert got["a", 11].problem == "not found" and got["b", 1].problem == "not found"
    assert sorted(r.job_id for r in found.where("action = 'expired'").collect()) == ["a", "a-retry-1"]
    assert [(r.job_id, r.status) for r in machine.current_jobs(found).collect()] == [("a-retry-2", "processing")]
    assert machine.refused(found).count() == 6
    assert steps(spark, []).count() == 0


def random_messages(seed: int, jobs: int = 30) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for k in range(jobs):
        at = draw.randint(0, 600)
        for seq in range(draw.randint(1, 12)):
            job = f"j{k}" + draw.choice(["", "", "", "-retry-1"])
            action = draw.choice(["create", "update", "update", "update", "cancel", "retry", "delete"]) if seq else "create"
            status = draw.choice([None, "processing", "failed", "completed"]) if action == "update" else None
            rows.append(message(job, seq, at, action, status, draw.choice([None, -1.0, 0.5, 2.0]), draw.choice([None, "é"])))
            at += draw.choice([0, 1, 30, 200, 2000])
    return rows + draw.sample(rows, len(rows) // 4)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_fold(spark, tmp_path, seed):
    """Messages come shuffled within an hour, repeated, in several files; a last one moves the watermark past all."""
    draw = random.Random(seed)
    rows = sorted(random_messages(seed), key=lambda r: r[2].timestamp() + draw.random() * 3500)
    end = START + timedelta(days=30)
    size = -(-len(rows) // 4)
    last = [("zz", 1, end, "create", None, None, None, None)], [("zz", 2, end + timedelta(hours=2), "create", None, None, None, None)]
    for k, part in enumerate([*[rows[i : i + size] for i in range(0, len(rows), size)], *last]):
        spark.createDataFrame(part, machine.MESSAGE).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:02}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(machine.MESSAGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        run = machine.run_messages(stream, late="2 hours").writeStream.outputMode("append").format("memory").queryName(f"steps{seed}").option("checkpointLocation", str(tmp_path / "state")).start()
        run.processAllAvailable()
        run.stop()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = steps(spark, rows, until=str(end)).collect()
    got = spark.table(f"steps{seed}").where("job_id <> 'zz'").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert len({r.problem for r in want}) > 5 and any(r.action == "expired" for r in want)
