"""The ring of durations in a stream, against the last by number."""

from __future__ import annotations

import random

from quillspark.streaming import rolling

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_ring(spark, tmp_path):
    """Calls come shuffled over many batches; errors and operations without a success, too."""
    draw = random.Random(5)
    rows = [("a" if k % 3 else "b", k, round(draw.random(), 3), k % 4 > 0) for k in range(600)] + [("c", 1, 2.0, False), ("d", 1, 3.0, None), (None, 1, 1.0, True)]
    draw.shuffle(rows)
    schema = "op string, seq long, duration double, success boolean"
    for k in range(6):
        spark.createDataFrame(rows[k::6], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = rolling.rolling_metrics(stream, ring=50, last=20, expected={"a": 500, "c": 0}).writeStream.outputMode("update").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    run.awaitTermination()
    found = {r.op: r for r in rolling.newest(own.table("rolled")).collect()}
    for op in "ab":
        mine = sorted(r[1:] for r in rows if r[0] == op)
        good = [d for _, d, ok in mine if ok]
        r = found[op]
        assert (r.calls, r.errors) == (len(mine), len(mine) - len(good)) and abs(r.total_time - sum(good)) < 1e-6
        assert abs(r.recent_avg - sum(good[-20:]) / 20) < 1e-9
    assert found["a"].remaining == 100 and abs(found["a"].seconds_left - 100 * found["a"].recent_avg) < 1e-9 and found["b"].remaining is None
    assert (found["c"].errors, found["c"].recent_avg, found["c"].remaining, found["d"].errors) == (1, None, 0, 1) and set(found) == set("abcd")
