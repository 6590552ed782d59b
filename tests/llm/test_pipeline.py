"""The pipeline and the SQL oracles over the smallest tables."""

from __future__ import annotations

import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontam, quality, queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before, own = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        own[name] = {r.doc_id for r in after.collect()}
        if name == "quality":
            assert own[name] == {r.doc_id for r in quality.op7_quality(before).where("kept").collect()}
        if name == "near_dedup":
            texts = [r.text for r in after.collect()]
            assert len(texts) == len(set(texts))
        if name == "decontaminate":
            bad = {r.doc_id for r in decontam.op6_decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
            assert own[name] == own["near_dedup"] - bad
        before = after
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == before.count() and {r.doc_id for r in out} == own["mix"]
    assert [r.start for r in sorted(out, key=lambda r: r.start)][0] == 0


def test_odd_tables(spark, tmp_path):
    """No documents give no tokens; ids that repeat with several texts lose none of them."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    draw = random.Random(1)
    texts = [" ".join(f"t{k}w{draw.randint(0, 9999)}" for _ in range(80)) for k in range(4)]
    rows = [(5, texts[0], None, "a", 1), (5, texts[1], None, "a", 1), (7, texts[0] + " tail", None, "a", 1), (None, texts[2], "x", None, None), (9, None, None, None, None), (2**62, texts[3], None, "a", 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted([(5, texts[0]), (5, texts[1]), (None, texts[2]), (2**62, texts[3])], key=repr)


def test_clashing_columns(spark, tmp_path):
    """Columns with the names that stages use inside come along through all of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["row", "own_id", "own_md5", "size", "k", "times", "h", "keeper", "digest", "kept", "spans", "source_size", "n", "cell", "first"]
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names}).cache()
    plain = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide, plain = stage(spark, wide, SF).cache(), stage(spark, plain, SF).cache()
    key = lambda frame: sorted((r.doc_id, r.text) for r in frame.collect())
    assert wide.columns == [*docs.columns, *names] and key(wide) == key(plain)
    assert all(r[c] == f"{c}{r.doc_id}" for r in wide.collect() for c in names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = queries.queries()[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(names).collect()), key=repr)
    found = con.execute(queries.oracle_sql()[name])
    place = [[c[0] for c in found.description].index(n) for n in names]
    assert got == sorted((tuple(r[k] for k in place) for r in found.fetchall()), key=repr)


def test_every_operator_has_a_query():
    found = queries.queries()
    assert all(any(re.match(f"op{n}_", q) for q in found) for n in range(1, 14))


def test_nothing_else_imports_llm():
    root = Path(corpus_pipeline.__file__).parent
    for path in (root / "quillspark").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert ".llm" not in path.read_text(), path
