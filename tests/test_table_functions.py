"""Table functions of SQL against the DataFrame forms."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import mathx, table_functions
from quillspark.streaming import machine


def test_math_spans(spark):
    table_functions.register(spark)
    docs = spark.createDataFrame([(1, "a/b and $x$"), (2, None), (3, "plain"), (4, "")], "doc_id long, text string")
    docs.createOrReplaceTempView("few_docs")
    found = spark.sql("SELECT doc_id, begin, end, match, math_type, confidence, latex FROM few_docs, LATERAL math_spans(text)")
    want = mathx.recognised(docs).select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 2
    with pytest.raises(Exception, match="takes a text"):
        spark.sql("SELECT * FROM math_spans(12)").collect()


def test_job_steps(spark):
    table_functions.register(spark)
    at = datetime(2024, 1, 1)
    rows = [("a", 1, at, "create", None, None, None, None), ("a", 2, at, "update", "failed", 0.5, None, "x"), ("a", 2, at, "update", "failed", 0.5, None, "x"), ("a", 3, at, "retry", None, None, None, None), ("a-retry-1", 4, at, "cancel", None, None, None, None), ("b", 1, at, "delete", None, None, None, None), ("c", None, at, "create", None, None, None, None)]
    messages = spark.createDataFrame(rows, machine.MESSAGE)
    machine.by_family(messages).withColumn("at", F.unix_micros("at")).createOrReplaceTempView("few_messages")
    found = machine.timed(spark.sql("SELECT * FROM job_steps(TABLE(few_messages))"))
    want = machine.fold_messages(messages)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and found.count() == 5
    with pytest.raises(Exception, match="job_steps takes"):
        spark.sql("SELECT * FROM job_steps(TABLE(SELECT 1 AS x))").collect()
