"""Every query against its oracle on the smallest tables, and golden examples."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillspark.functions import classify
from quillspark.operators import code, inference, mathx, outline, tables
from quillspark.plans import queries as plans
from quillspark.sources import corpus
from quillspark.streaming import jobs as job_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    frame = plans.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    found = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = sorted([plain(r[columns.index(n)]) for n in names] for r in found.fetchall())
    assert sorted([plain(v) for v in r] for r in frame.select(names).collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())


def lines(spark, text):
    return corpus.explode_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def test_delimited_table(spark):
    found = lines(spark, "Name,Age,City\nAnn,3,Rome\nBob,4,Oslo\nEve,5,Bonn").withColumnRenamed("doc_id", "block_id")
    cells = tables.delimited_cells(found)
    assert cells.count() == 12 and tables.valid_tables(cells).count() == 1
    assert tables.header_score(cells).first().is_header
    prose = lines(spark, "One line.\nAnother one here.\nA third.").withColumnRenamed("doc_id", "block_id")
    assert tables.delimited_cells(prose).count() == 0


def test_space_columns(spark):
    found = lines(spark, "name          age           city\nann           3             rome").withColumnRenamed("doc_id", "block_id")
    assert sorted(r.start for r in tables.word_columns(found).collect()) == [0, 14, 28]


def test_math(spark):
    frame = spark.createDataFrame([(1, "é $x^2$ p/q and x^{2} ∫ a_b")], "doc_id long, text string")
    found = {(r.math_type, r.match, r.latex) for r in mathx.outermost(mathx.math_spans(frame)).collect()}
    assert found == {("inline", "$x^2$", "$x^2$"), ("fraction", "p/q", "\\frac{p}{q}"), ("superscript", "x^{2}", "x^{2}"), ("integral", "∫", "\\int"), ("subscript", "a_b", "a_{b}")}


def test_code_regions(spark):
    text = "prose words\ndef f(x):\n\n    return x;\nx += 1;\nmore prose\n{\n}"
    found = code.code_regions(lines(spark, text)).collect()
    assert [(r.start_line, r.end_line) for r in found] == [(1, 4)]


def test_outline(spark):
    found = outline.structured_lines(lines(spark, "DOMAIN I PEOPLE —33%\nTask 1 Develop it\n• x\nSome long section .... 12\nTotal 33%\nprose"))
    assert [(r.content_type, r.level) for r in found.orderBy("line_no").collect()] == [("domain", 1), ("task", 2), ("bullet", 3), ("table_of_contents", 1), ("percentage_breakdown", 2)]


def test_classes(spark):
    frame = spark.createDataFrame([("| a | b | c |",), ("# A heading | x | y | z",), ("",), ("1. item | | |",)], "t string")
    assert [r[0] for r in frame.select(classify.text_class(F.col("t"))).collect()] == ["TABLE", "TEXT", "TEXT", "TEXT"]


def test_stream_equals_batch(spark, tmp_path):
    """Job events that arrive in several files fold to the batch result."""
    events = job_stream.job_events(corpus.jobs(spark, SF)).repartition(4)
    path = str(tmp_path / "events")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = job_stream.fold_jobs(stream).writeStream.outputMode("complete").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    want = sorted(map(tuple, job_stream.fold_jobs(events).collect()))
    assert sorted(map(tuple, spark.table("folded").collect())) == want


def test_model_calls(spark):
    """A call that fails is made again; one that always fails becomes an error of its row."""

    def make():
        seen = {}

        def client(body):
            seen[body] = seen.get(body, 0) + 1
            if body == "bad" or body == "shaky" and seen[body] < 2:
                raise TimeoutError("late")
            return "ok"

        return client

    rows = [(1, "good"), (2, "shaky"), (3, "bad"), (4, None)]
    found = inference.call_model(spark.createDataFrame(rows, "k int, body string").coalesce(1), make, retries=2, delay=0.01)
    assert sorted((r.k, r.reply, r.error, r.attempts) for r in found.collect()) == [(1, "ok", None, 1), (2, "ok", None, 2), (3, None, "TimeoutError: late", 3), (4, None, "no request", 0)]


def test_reply_text(spark):
    bodies = ['{"choices":[{"message":{"content":"a"}}]}', '{"content":[{"text":"b"}]}', '{"content":"c"}', '{"text":"d"}', '{"response":"e"}', '{"output":"f"}', "g"]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1)
    assert [r[0] for r in frame.select(inference.reply_text(F.col("body"))).collect()] == list("abcdefg")
