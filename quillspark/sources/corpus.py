"""Base views: lines, elements, recognised words, jobs, operation events, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import file_problem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def explode_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs(key, text) -> key, line_no (from 0), line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def join_lines(lines: DataFrame, key: str = "doc_id", sep: str = "\n") -> DataFrame:
    """Ordered concatenation: lines(key, line_no, line) -> key, text."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), sep).alias("text"))


def files(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True, max_bytes: int = 52_428_800) -> DataFrame:
    """Input files with the reason why one is not taken (null: it is); Spark itself passes over empty files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.withColumn("error", file_problem(F.col("path"), F.col("length"), F.col("content"), max_bytes))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of text with their size, some blank: two line items to a line, four to a block."""
    n, kept = F.col("l_linenumber"), F.col("l_quantity") <= 45
    text = F.when(kept, F.concat("l_returnflag", F.lit("x "), F.col("l_partkey").cast("string"))).when(n % 2 == 0, " ").otherwise("")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 5).cast("int").alias("page_number"), F.floor(n / 4).cast("int").alias("block_no"), F.floor((n % 4) / 2).cast("int").alias("line_no"),
        F.struct(n, "l_partkey").alias("span_no"), text.alias("text"), F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).otherwise(0.0).alias("size"),
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages for each order, some with odd sizes, numbers and methods."""
    k = F.col("o_orderkey")
    page = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("page_index"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"))
    method = F.when(F.col("c") % 7 == 0, "failed").when(F.col("c") % 7 == 1, "ocr_fallback").when(F.col("c") % 7 == 2, "vlm")
    return page.select(
        "doc_id", "page_index", F.when(F.col("c") % 11 == 0, F.col("page_index") - 1).otherwise(F.col("page_index")).alias("page_number"), (F.col("c") % 13 * 50).cast("double").alias("width"), F.lit(792.0).alias("height"),
        F.when(F.col("c") % 17 == 0, 0).otherwise(300).alias("dpi"), method.alias("processing_method"), F.when(F.col("page_index") > 0, F.col("p")).alias("raw_text"),
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout elements, one for each line item."""
    kind = F.when(F.col("l_returnflag") == "A", "TABLE").when(F.col("l_returnflag") == "N", "TEXT").when(F.col("l_linestatus") == "F", "CODE").otherwise("MATHEMATICAL")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("l_discount") * 5))
    place = F.when(F.col("l_linenumber") % 4 != 0, F.struct((F.col("l_partkey") % 50).cast("double").alias("x0"), (F.col("l_suppkey") % 40).cast("double").alias("y0")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_suppkey") % 5).cast("int").alias("page_number"),
        F.col("l_linenumber").alias("elem_no"),
        kind.alias("content_type"),
        F.round(confidence, 4).alias("confidence"),
        (8 + F.col("l_quantity") / 5).alias("font_size"),
        place.alias("bbox"),
    )


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words: four line items to a line of an image."""
    words = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return words.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("word_no"),
        F.col("p_name").alias("text"),
        F.when(F.col("l_quantity") > 45, -1.0).otherwise(F.col("l_quantity") * 2).alias("conf"),
        (F.col("l_partkey") % 500).cast("int").alias("left"),
        (F.col("l_suppkey") % 300).cast("int").alias("top"),
        (10 + F.col("l_linenumber") * 5).cast("int").alias("width"),
        F.lit(15).alias("height"),
        F.floor(F.col("l_linenumber") / 4).cast("int").alias("line_num"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max("l_shipdate").alias("shipped"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 3 == 0, "pending").otherwise("processing")).otherwise(F.when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("cancelled"))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    return found.join(done, "job_id", "left").select("job_id", "status", "created_at", F.when(F.col("status") == "completed", F.col("shipped")).alias("completed_at"))


def op_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each operation; ``seq`` is the number that the source gives them."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.col("event_id").alias("seq"), F.col("value").alias("duration"), (F.col("event_id") % 7 != 0).alias("success"), "ts", "user_id", "event_id")


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.sha2(F.concat_ws("|", "p_name", F.col("p_partkey").cast("string")), 256).alias("key"), F.col("p_brand").alias("cache"), (F.col("p_size") * 1000).cast("long").alias("size_bytes"), (F.col("p_partkey") % 17).cast("long").alias("access_count"), ((F.col("p_partkey") * 7919) % 100_003).cast("double").alias("last_access"), F.col("p_partkey").alias("entry_id"))
