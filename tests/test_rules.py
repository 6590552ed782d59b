"""Golden examples of rules, tables, code, files and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import errors, rules
from quillspark.operators import code, mathx, metrics, outline, pages, tables
from quillspark.sinks import writers
from quillspark.sources import corpus
from quillspark.streaming import jobs as job_stream


def blocks(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return corpus.explode_lines(frame).withColumnRenamed("doc_id", "block_id")


def rendered(spark, text):
    return tables.format_elements(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text


def test_render_delimited(spark):
    assert rendered(spark, "Name,Age,City\n Ann ,3,Rome\nEve,5,Bonn\nBob,44") == "\n".join([
        "|    Name    |    Age     |    City    |",
        "|------------|------------|------------|",
        "|    Ann     |          3 |    Rome    |",
        "|    Eve     |          5 |    Bonn    |",
        "|    Bob     |         44 |            |",
    ])


def test_not_a_table(spark):
    assert rendered(spark, "One line.\nAnother one here.\nA third.") == "\nOne line.\nAnother one here.\nA third.\n"
    assert rendered(spark, "") == "\n\n"


def test_first_detector_decides(spark):
    wide = "\n".join(",".join("x" * 25) for _ in range(3))
    long = "\n".join("a,b" for _ in range(51))
    grid = "+--+--+\n+ a + b +\n+--+--+\n+ 1 + 2 +\n+--+--+"
    spaced = "name           age\nann            3\nbob            44"
    got = tables.table_cells(blocks(spark, wide, long, grid, spaced, "a,b", None)).groupBy("block_id").agg(F.count("*").alias("n"), F.max("confidence").alias("c")).collect()
    assert sorted((r.block_id, r.n, r.c) for r in got) == [(2, 4, 0.8), (3, 6, 0.7)]


def test_vision_tables(spark):
    pipe = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |"
    found = tables.vision_cells(blocks(spark, pipe, "| a | b | and | c | d | then | e | f |\n", "no table")).collect()
    assert sorted((r.block_id, r.row, r.col, r.text) for r in found if r.block_id == 0) == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "1"), (0, 1, 1, "2"), (0, 2, 0, "3")]
    assert {r.block_id for r in found} <= {0, 1}


def test_format_tables(spark):
    text = "before\n| a | b |\n|--|--|\n| 1 | 2 |\n| 3 | 4 |\nafter, one\n\nx | y\nend"
    out = tables.format_tables(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1].split("\n")[0] == "before" and got[1].split("\n")[-4:] == ["after, one", "", "x | y", "end"]
    assert "|     a      |     b      |" in got[1] and got[2] == "" and got[3] == "plain"


@pytest.mark.parametrize(("name", "snippet"), [("python", "def f(x):\n    import math\n    print(len(x))"), ("go", "package main;\nfunc f(a int) error {\n  defer close(a);\n}"), ("sql", "SELECT a,\nSUM(b),\nFROM t WHERE a;"), ("bash", "#!/bin/bash\nif [ -f x ]; then\necho $v;\nfi;")])
def test_languages(spark, name, snippet):
    found = code.code_blocks(corpus.explode_lines(spark.createDataFrame([(1, snippet)], "doc_id long, text string"))).collect()
    assert [r.language for r in found] == [name] and found[0].confidence >= 0.6


def test_long_numbered_code(spark):
    snippet = "\n".join(f"def f{k}(x):" for k in range(60))
    out = code.format_code(spark.createDataFrame([(1, snippet)], "doc_id long, text string"), numbered=True).first().text.split("\n")
    assert out[0] == "```python" and out[1] == "  1 | def f0(x):" and out[51:] == ["... (truncated)", "```"]


def test_spans_and_splice(spark):
    frame = spark.createDataFrame([(1, "é $x^2$ p/q and x^{2} ∫ a_b"), (2, None), (3, "plain words"), (4, "a/b " * 40)], "doc_id long, text string")
    one, two = ({(r.doc_id, r.begin, r.end, r.latex) for r in f.collect()} for f in (mathx.recognised(frame), mathx.outermost(mathx.math_spans(frame))))
    assert one == two and sum(r[0] == 4 for r in one) == 40
    got = {r.doc_id: r.text for r in mathx.format_math(frame).collect()}
    assert got == {1: "é $x^2$ \\frac{p}{q} and x^{2} \\int a_{b}", 2: None, 3: "plain words", 4: "\\frac{a}{b} " * 40}


def test_latex_checks(spark):
    texts = ["x", "$x$", "\\(x\\)", "{x", "", "x\\\\", "\\$5"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    found = [tuple(r) for r in frame.select(rules.latex_ok(F.col("t")), rules.latex_ok(F.col("t"), False)).collect()]
    assert found == [(True, True), (False, True), (True, True), (False, False), (False, False), (False, False), (True, False)]


def test_recognition_is_needed(spark):
    shown = [(1, 0, "failed", "t"), (1, 1, "ocr_fallback", None), (1, 2, None, "t"), (1, 3, None, "t"), (1, 4, None, None)]
    frame = spark.createDataFrame(shown, "doc_id int, page_number int, processing_method string, raw_text string")
    found = spark.createDataFrame([(1, 2, 0.3), (1, 3, 0.9)], "doc_id int, page_number int, confidence double")
    assert {r.page_number: r.needs_ocr for r in pages.needs_recognition(frame, found).collect()} == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_metrics(spark):
    events = spark.createDataFrame([("a", 1, 1.5, True), ("a", 2, 2.5, True), ("a", 3, 1.0, False), ("b", 4, 9.0, False)], "op string, seq long, duration double, success boolean")
    found = {r.op: r for r in metrics.operation_metrics(events).collect()}
    assert tuple(found["a"])[1:] == (3, 4.0, 1.5, 2.5, 1, 0.666667, 2.0)
    assert found["b"].min_time is None and found["b"].avg_time is None
    summary = metrics.summary(metrics.operation_metrics(events)).first()
    assert (summary.total_operations, summary.total_errors, summary.overall_success_rate) == (4, 2, 0.5)


def test_errors(spark):
    frame = spark.createDataFrame([("TIMEOUT_ERROR",), ("CONFIG_ERROR",), ("what",)], "code string").coalesce(1)
    assert {tuple(r) for r in errors.described(frame).collect()} == {("TIMEOUT_ERROR", "low", True), ("CONFIG_ERROR", "critical", False), ("what", "low", False)}
    row = frame.select(errors.wrapped(F.lit("m"), F.col("code"), {"page": F.lit(3)}).alias("e")).first().e
    assert tuple(row) == ("TIMEOUT_ERROR", "m", '{"page":3}')


def test_files(spark, tmp_path):
    for name, content in {"a.pdf": b"%PDF-1.7 x", "b.PDF": b"%PDF", "d.pdf": b"GIF8", "sub/e.pdf": b"%PDF" + b"x" * 99, "f.txt": b"%PDF"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    found = corpus.files(spark, str(tmp_path), "*", max_bytes=50)
    assert {r.path.rsplit("/", 1)[1]: r.error for r in found.collect()} == {"a.pdf": None, "b.PDF": None, "d.pdf": "header", "e.pdf": "too large", "f.txt": "suffix"}
    assert corpus.files(spark, str(tmp_path), "*.pdf", recursive=False).count() == 2


def test_uploads_stream(spark, tmp_path):
    """Files that arrive later are taken by the next run, and none twice."""
    (tmp_path / "in").mkdir()

    def run():
        convert = lambda rows: rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "error", F.length("content").alias("size"))
        job_stream.convert_uploads(spark, str(tmp_path / "in"), convert, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted((r.name, r.error, r["size"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF 1")
    assert run() == [("a.pdf", None, 6)]
    (tmp_path / "in" / "b.pdf").write_bytes(b"junk")
    assert run() == [("a.pdf", None, 6), ("b.pdf", "header", 4)]


def test_live_jobs_stream(spark, tmp_path):
    """Repeated events are told apart in a stream as in a table, within the watermark."""
    rows = [(1, 7, "pending", "2024-01-01 00:00:00"), (1, 7, "pending", "2024-01-01 00:00:00"), (2, 7, "processing", "2024-01-01 00:05:00"), (2, 7, "processing", "2024-01-01 00:05:00"), (3, 8, "pending", "2024-01-01 00:06:00")]
    events = spark.createDataFrame(rows, "event_id long, job_id long, status string, at string").withColumn("at", F.col("at").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    run = job_stream.live_jobs(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, job_stream.live_jobs(events).collect()))


def test_requests(spark):
    jobs = spark.createDataFrame([(1, "pending"), (2, "processing"), (3, "failed"), (4, "completed")], "job_id long, status string")
    asked = [(i, a) for i in (1, 2, 3, 4, 9) for a in ("cancel", "retry", "delete", "burn")]
    found = job_stream.apply_requests(jobs, spark.createDataFrame(asked, "job_id long, action string")).collect()
    assert {(r.job_id, r.action) for r in found if r.accepted} == {(1, "cancel"), (2, "cancel"), (3, "retry"), (1, "delete"), (3, "delete"), (4, "delete")}
    assert {r.problem for r in found if r.job_id == 9} == {"not found"} and all(r.problem for r in found if not r.accepted)


def test_markdown_round_trip(spark, tmp_path):
    rows = [("a", "# A\n\ntext é\n"), ("b c", None), ("d", "no end")]
    writers.write_markdown(spark.createDataFrame(rows, "name string, markdown string"), str(tmp_path / "md"), "name")
    assert sorted(map(tuple, writers.read_markdown(spark, str(tmp_path / "md"), "name").collect())) == [("a", "# A\n\ntext é\n"), ("b c", ""), ("d", "no end")]


def test_census(spark):
    text = "Contents " + "." * 32 + " 3\nDOMAIN I People 42%\nTask 1 x\n• bullet\na | b | c | d\nwidth 10 20\ncost   $5\n\n"
    found = outline.line_census(corpus.explode_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert found.asDict() == {"dots": 1, "pipes": 1, "tabs": 0, "spaces": 1, "tasks": 1, "domains": 1, "bullets": 1, "percents": 1, "table_rows": 1, "in_columns": 4}
