"""Markdown files, JSON reports, log events and the result store.

All are written by Spark's own writers, so a task that is lost and made again
leaves no half-written file.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which all machines share; only a local session may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    return f"{shared}/{name}-{uuid.uuid4().hex}"


# Kinds of log events and the loggers that they go to.
LOGGERS = {"request": "requests", "system": "system", "performance": "performance", "error": "errors"}


def write_markdown(docs: DataFrame, path: str, name: str = "doc_id") -> None:
    """docs(name, markdown) -> a folder ``name=value`` for each document with its text, UTF-8."""
    docs.select(name, F.coalesce("markdown", F.lit("")).alias("value")).write.partitionBy(name).option("lineSep", "\n").mode("overwrite").text(path)


def read_markdown(spark: SparkSession, path: str, name: str = "doc_id") -> DataFrame:
    """name, markdown of what ``write_markdown`` wrote."""
    found = spark.read.text(path, wholetext=True)
    return found.select(name, F.regexp_replace("value", "\\n\\z", "").alias("markdown"))


def batch_results(docs: DataFrame, folder: str, stop_on_error: bool = False, order: str = "doc_id") -> DataFrame:
    """docs(file, markdown, error, order) -> file, success, output, error, markdown of each.

    Outputs are named after the file's stem.  With ``stop_on_error`` the rows
    after the first failure (by ``order``) are left out.
    """
    if stop_on_error:
        first = docs.where("error IS NOT NULL").agg(F.min(order)).scalar()
        docs = docs.where(first.isNull() | (F.col(order) <= first))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), "\\.[^.]*$", "")
    ok = F.col("error").isNull()
    return docs.select("file", ok.alias("success"), F.when(ok, F.concat(F.lit(f"{folder}/"), stem, F.lit(".md"))).alias("output"), "error", F.when(ok, F.col("markdown")).alias("markdown"))


def metrics_export(metrics: DataFrame, summary: DataFrame, at: Column) -> DataFrame:
    """One row: the JSON of the time, the summary and each operation's metrics."""
    detailed = metrics.agg(F.sort_array(F.collect_list(F.struct(*metrics.columns))).alias("detailed_metrics"))
    return summary.select(F.struct(*summary.columns).alias("summary")).join(F.broadcast(detailed)).select(F.to_json(F.struct(at.alias("timestamp"), "summary", "detailed_metrics")).alias("value"))


def performance_report(metrics: DataFrame, summary: DataFrame, resources: DataFrame, advice: DataFrame, at: Column, configuration: dict[str, object]) -> DataFrame:
    """One row: the JSON of summary, metrics, resources, advice and configuration."""
    gathered = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    parts = summary.select(F.struct(*summary.columns).alias("performance_summary"))
    for df, name in ((metrics, "detailed_metrics"), (resources, "resource_summary"), (advice, "optimization_recommendations")):
        parts = parts.join(F.broadcast(gathered(df, name)))
    settings = F.struct(*[F.lit(v).alias(k) for k, v in configuration.items()]).alias("configuration")
    return parts.select(F.to_json(F.struct(at.alias("timestamp"), "performance_summary", "detailed_metrics", "resource_summary", "optimization_recommendations", settings)).alias("value"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """rows(value) -> text files, a JSON document to a line."""
    rows.select("value").write.mode("append").text(path)


def log_event(kind: str, at: Column, message: Column, **more: Column) -> Column:
    """A log event as JSON: time, kind, logger, message, and what else is known."""
    known = [c.alias(k) for k, c in more.items()]
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.to_json(F.struct(stamp.alias("timestamp"), F.lit(kind).alias("event_type"), F.lit(LOGGERS[kind.split("_")[0]]).alias("logger"), message.alias("message"), *known))


def performance_event(at: Column, operation: Column, seconds: Column) -> Column:
    message = F.concat(F.lit("Operation '"), operation, F.lit("' completed in "), F.format_string("%.3f", seconds), F.lit("s"))
    return log_event("performance", at, message, operation=operation, duration=seconds)


def error_event(at: Column, operation: Column, error: Column) -> Column:
    message = F.concat(F.lit("Error in operation '"), operation, F.lit("': "), error)
    return log_event("error", at, message, operation=operation, error=error)


def request_event(at: Column, request_id: Column, operation: Column, status: Column, seconds: Column, **more: Column) -> Column:
    """A request and how it ended: success, error or timeout."""
    message = F.concat(F.lit("Request "), request_id, F.lit(": "), operation, F.lit(" - "), status)
    return log_event("request", at, message, request_id=request_id, operation=operation, status=status, duration=seconds, **more)


def system_event(at: Column, kind: str, message: Column, **more: Column) -> Column:
    """An event of the system; its kind is told as ``system_`` and the kind."""
    return log_event(f"system_{kind}", at, message, **more)


def write_results(results: DataFrame, path: str) -> None:
    """results(key, value, stored_at) -> the result store, in folders by the key's first two characters."""
    results.select("key", "value", "stored_at", F.octet_length("value").cast("long").alias("size_bytes"), F.left("key", F.lit(2)).alias("shard")).write.mode("append").partitionBy("shard").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The newest value of each key in the store; folders are text, also those that look like numbers."""
    rows = spark.read.schema("key string, value string, stored_at timestamp, size_bytes long, shard string").parquet(path)
    newest = F.max_by(F.struct("value", "size_bytes"), F.struct("stored_at", "value"))
    return rows.groupBy("key").agg(newest.alias("v"), F.max("stored_at").alias("stored_at")).select("key", "v.value", "v.size_bytes", "stored_at")
