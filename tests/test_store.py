"""The store in buckets: plans that move no stored row, generations, a second session's view."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quillspark.sinks import store


@pytest.fixture
def filled(spark, tmp_path):
    own = store.create(spark, f"file://{tmp_path}/store", 8)
    for k, day in enumerate(("2024-01-01", "2024-01-03", "2024-01-02")):
        own.put(spark.range(100).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(f"v{k}").alias("value"), F.lit(day).cast("timestamp").alias("stored_at")))
    return own


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_of_the_store(spark, filled):
    assert "Exchange" not in plan(filled.newest())
    asked = spark.range(150).select("id", F.concat(F.lit("k"), "id").alias("key"))
    found = filled.look_up(asked)
    text = plan(found)
    assert len(re.findall(r"\bExchange\b", text)) == 1 and "Bucketed: true" in text
    assert {(r.id, r.value) for r in found.collect()} == {(k, "v1" if k < 100 else None) for k in range(150)}


def test_buckets_are_pruned(filled):
    found = filled.get("k7")
    assert re.search(r"SelectedBucketsCount: 1 out of 8", plan(found))
    assert [(r.key, r.value) for r in found.collect()] == [("k7", "v1")]


def test_reopened_and_compacted(spark, filled, tmp_path):
    spark.sql(f"DROP TABLE {filled.table}")  # as in a session that has not seen it
    again = store.open_store(spark, filled.path)
    assert again.buckets == 8 and again.rows().count() == 300
    small = again.compact(f"file://{tmp_path}/small")
    assert small.rows().count() == 100 and sorted(map(tuple, small.newest().collect())) == sorted(map(tuple, again.newest().collect()))
    with pytest.raises(Exception):  # noqa: B017  a store is not made twice
        store.create(spark, filled.path)


def test_empty_and_null_keys(spark, tmp_path):
    own = store.create(spark, f"file://{tmp_path}/e", 2)
    assert own.newest().count() == 0
    own.put(spark.createDataFrame([(None, "x", None), ("a", None, None)], "key string, value string, stored_at timestamp"))
    assert [r.key for r in own.newest().collect()] == ["a"]
