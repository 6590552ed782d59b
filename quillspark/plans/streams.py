"""Queries of the job machine and their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import mathx, table_functions
from ..sinks import writers
from ..sources import corpus
from ..streaming import machine, monitor, rolling
from . import sql as D
from .queries import ORACLES, QUERIES

UNTIL = "1994-01-01 00:00:00"


def job_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a job for each order, out of order: its lines report progress, some twice; requests conflict, come late or for jobs that are not there."""
    o = corpus.table(spark, sf_dir, "orders")
    k, kind = F.col("o_orderkey"), F.col("o_orderstatus")
    null = F.lit(None).cast("string")

    def one(fits: Column, seq: int, minutes: int, action: str, status: Column = null, progress: float | None = None, suffix: str = "", error: Column = null) -> Column:
        at = F.col("o_orderdate").cast("timestamp") + F.expr(f"INTERVAL {minutes} MINUTE")
        fields = (F.concat(k.cast("string"), F.lit(suffix)).alias("job_id"), F.lit(seq).cast("long").alias("seq"), at.alias("at"), F.lit(action).alias("action"), status.alias("status"), F.lit(progress).cast("double").alias("progress"), null.alias("message"), error.alias("error"))
        return F.when(fits, F.struct(*fields))

    ended = F.when((kind == "F") & (k % 4 < 3), "completed").otherwise("failed")
    sent = F.array(
        one(k % 13 != 0, 0, 0, "create"), one(k % 9 == 0, 25, 150, "delete"), one(k % 5 == 0, 35, 210, "cancel"), one(k % 5 == 0, 36, 210, "cancel"),
        one(kind != "O", 80, 480, "update", ended, error=F.when(ended == "failed", "no answer")), one(k % 2 == 0, 90, 540, "retry"), one(k % 2 == 0, 91, 540, "retry"), one(k % 4 == 0, 100, 600, "delete"),
        one(k % 2 == 0, 110, 660, "update", F.lit("processing"), -0.5, "-retry-1"), one(k % 3 == 0, 120, 2400, "retry"), one(k % 17 == 0, 0, 2500, "create"),
    )
    requests = o.select(F.inline(F.array_compact(sent)))
    n = F.col("l_linenumber")
    lines = corpus.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), n, "l_partkey").join(o.select("o_orderkey", "o_orderdate"), "o_orderkey")
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + n.cast("long") * machine.HOUR)
    progress = lines.select(k.cast("string").alias("job_id"), (n * 10).cast("long").alias("seq"), at.alias("at"), F.lit("update").alias("action"), F.lit("processing").alias("status"), ((n * 3 - 2) / 10).alias("progress"), F.concat(F.lit("line "), n.cast("string")).alias("message"), null.alias("error"), "l_partkey")
    repeated = progress.where("l_partkey % 3 = 0")
    return requests.unionByName(progress.drop("l_partkey")).unionByName(repeated.drop("l_partkey"))


ALLOWED = " ".join(f"WHEN '{a}' THEN target.status IN ({', '.join(repr(s) for s in states)})" for a, states in machine.ALLOWED.items())
JOB = "STRUCT(id VARCHAR, status VARCHAR, progress DOUBLE, started BIGINT, completed BIGINT, message VARCHAR, error VARCHAR, retries INTEGER)"
NEW = "CAST({{'id': {0}, 'status': 'pending', 'progress': 0, 'started': NULL, 'completed': NULL, 'message': {1}, 'error': NULL, 'retries': 0}} AS " + JOB + ")"
AFTER = f"""CAST(CASE action WHEN 'retry' THEN {{'id': job_id, 'status': target.status, 'progress': target.progress, 'started': target.started, 'completed': target.completed, 'message': target.message, 'error': target.error, 'retries': target.retries + 1}}
    ELSE {{'id': job_id, 'status': to_status, 'progress': CASE WHEN progress IS NULL THEN target.progress ELSE greatest(0, least(1, progress)) END, 'started': CASE WHEN to_status = 'processing' THEN coalesce(target.started, tm) ELSE target.started END,
      'completed': CASE WHEN to_status IN ('completed', 'failed', 'cancelled') THEN tm ELSE target.completed END, 'message': CASE WHEN action = 'cancel' THEN '{machine.CANCELLED}' ELSE coalesce(message, target.message) END, 'error': coalesce(error, target.error), 'retries': target.retries}} END AS {JOB})"""


def sent(seq: int, minutes: int, action: str, fits: str, status: str = "CAST(NULL AS VARCHAR)", progress: str = "NULL", suffix: str = "", error: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT o_orderkey || '{suffix}' AS job_id, {seq} AS seq, epoch_us(CAST(o_orderdate AS TIMESTAMP)) + {minutes * 60_000_000} AS tm, '{action}' AS action, {status} AS status, CAST({progress} AS DOUBLE) AS progress, CAST(NULL AS VARCHAR) AS message, {error} AS error FROM orders WHERE {fits}"


ENDED = "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 < 3 THEN 'completed' ELSE 'failed' END"
MESSAGES = " UNION ".join([
    sent(0, 0, "create", "o_orderkey % 13 <> 0"), sent(25, 150, "delete", "o_orderkey % 9 = 0"), sent(35, 210, "cancel", "o_orderkey % 5 = 0"), sent(36, 210, "cancel", "o_orderkey % 5 = 0"),
    sent(80, 480, "update", "o_orderstatus <> 'O'", ENDED, error=f"CASE WHEN {ENDED} = 'failed' THEN 'no answer' END"), sent(90, 540, "retry", "o_orderkey % 2 = 0"), sent(91, 540, "retry", "o_orderkey % 2 = 0"), sent(100, 600, "delete", "o_orderkey % 4 = 0"),
    sent(110, 660, "update", "o_orderkey % 2 = 0", "'processing'", "-0.5", "-retry-1"), sent(120, 2400, "retry", "o_orderkey % 3 = 0"), sent(0, 2500, "create", "o_orderkey % 17 = 0"),
    "SELECT CAST(o_orderkey AS VARCHAR), l_linenumber * 10, epoch_us(CAST(o_orderdate AS TIMESTAMP)) + l_linenumber * 3600000000, 'update', 'processing', (l_linenumber * 3 - 2) / 10::DOUBLE, 'line ' || l_linenumber, NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
])
TTL = 24 * machine.HOUR
STEPS = f"""WITH RECURSIVE messages AS ({MESSAGES}),
numbered AS (SELECT regexp_replace(job_id, '(-retry-[0-9]+)+$', '') AS family, row_number() OVER (PARTITION BY regexp_replace(job_id, '(-retry-[0-9]+)+$', '') ORDER BY tm, seq, job_id, action) AS n, * FROM messages),
walk(family, n, job_id, seq, tm, action, target, problem, jobs, gone) AS (
  SELECT family, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), NULL::INTEGER, NULL::BIGINT, NULL::VARCHAR, CAST(NULL AS {JOB}), NULL::VARCHAR, CAST([] AS {JOB}[]), CAST([] AS {JOB}[]) FROM (SELECT DISTINCT family FROM numbered)
  UNION ALL
  SELECT family, n, job_id, seq, tm, action,
    CASE WHEN problem IS NULL AND action IN ('update', 'cancel', 'retry') THEN after_ WHEN problem IS NULL AND action = 'create' THEN {NEW.format('job_id', 'NULL')} ELSE target END, problem,
    CASE WHEN problem IS NOT NULL THEN live WHEN action = 'create' THEN list_append(live, {NEW.format('job_id', 'NULL')}) WHEN action = 'delete' THEN rest
      WHEN action = 'retry' THEN list_concat(rest, [after_, {NEW.format("job_id || '-retry-' || (target.retries + 1)", f"'{machine.QUEUED}'")}]) ELSE list_append(rest, after_) END, gone
  FROM (SELECT *, list_filter(live, lambda j: j.id <> job_id) AS rest, {AFTER} AS after_,
          CASE WHEN action = 'create' THEN CASE WHEN target IS NOT NULL THEN 'already there' END WHEN target IS NULL THEN 'not found'
            WHEN NOT (CASE action {ALLOWED} ELSE false END) THEN 'cannot ' || action || ' a job that is ' || target.status END AS problem
        FROM (SELECT *, CASE WHEN action = 'cancel' THEN 'cancelled' ELSE coalesce(status, target.status) END AS to_status
              FROM (SELECT *, list_filter(live, lambda j: j.id = job_id)[1] AS target
                    FROM (SELECT w.family, m.n, m.job_id, m.seq, m.tm, m.action, m.status, m.progress, m.message, m.error,
                            list_filter(w.jobs, lambda j: j.completed IS NULL OR j.completed + {TTL} >= m.tm) AS live, list_filter(w.jobs, lambda j: j.completed + {TTL} < m.tm) AS gone
                          FROM walk w JOIN numbered m ON w.family = m.family AND m.n = w.n + 1)))) ),
lasts AS (SELECT jobs FROM walk QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC) = 1),
left_ AS (SELECT unnest(gone) AS j FROM walk UNION ALL SELECT j FROM (SELECT unnest(jobs) AS j FROM lasts) WHERE j.completed + {TTL} < epoch_us(TIMESTAMP '{UNTIL}')),
steps AS (
  SELECT job_id, CAST(seq AS BIGINT) AS seq, make_timestamp(tm) AS "at", action, problem IS NULL AS accepted, problem, CASE WHEN problem IS NULL AND action = 'retry' THEN job_id || '-retry-' || target.retries END AS new_job_id,
    target.status AS status, target.progress AS progress, make_timestamp(target.started) AS started_at, make_timestamp(target.completed) AS completed_at, target.message AS message, target.error AS error FROM walk WHERE n > 0
  UNION ALL
  SELECT j.id, NULL, make_timestamp(j.completed + {TTL}), 'expired', true, NULL, NULL, j.status, j.progress, make_timestamp(j.started), make_timestamp(j.completed), j.message, j.error FROM left_)
"""
QUERIES["x01b_job_machine"] = lambda spark, sf_dir: machine.fold_messages(job_messages(spark, sf_dir), until=UNTIL)
ORACLES["x01b_job_machine"] = STEPS + "SELECT * FROM steps"
QUERIES["x02b_refused"] = lambda spark, sf_dir: machine.refused(machine.fold_messages(job_messages(spark, sf_dir)))
ORACLES["x02b_refused"] = STEPS + 'SELECT job_id, seq, "at", action, problem FROM steps WHERE NOT accepted'
QUERIES["x04b_current_jobs"] = lambda spark, sf_dir: machine.current_jobs(machine.fold_messages(job_messages(spark, sf_dir), until=UNTIL))
ORACLES["x04b_current_jobs"] = STEPS + f"""SELECT j.id AS job_id, j.status, j.progress, make_timestamp(j.started) AS started_at, make_timestamp(j.completed) AS completed_at, j.message, j.error
FROM (SELECT unnest(jobs) AS j FROM lasts) WHERE j.completed IS NULL OR j.completed + {TTL} >= epoch_us(TIMESTAMP '{UNTIL}')"""


# measured jobs and streams --------------------------------------------------------


def measured_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of several operators, one of which fails, logged and read back."""
    docs, watch = corpus.table(spark, sf_dir, "documents"), monitor.Recorder(spark)
    log = writers.new_folder(spark, "op_events")
    sink = lambda frame: frame.write.format("noop").mode("overwrite").save()
    lines = corpus.explode_lines(docs)
    watch.run("lines", lines, sink, filled=F.count_if(F.trim("line") != ""))
    watch.run("markdown", docs.select(classify.has_markdown(F.col("text")).alias("found")), sink, found=F.count_if(F.col("found")))
    watch.flush(log)
    watch.measured("classes", sink, tables=F.count_if(F.col("kind") == "TABLE"))(lambda: lines.select(classify.text_class(F.col("line")).alias("kind")))()
    try:
        watch.run("broken", docs.select(F.raise_error(F.lit("no such page")).alias("x")), sink)
    except Exception:  # noqa: S110  it is in the log
        pass
    watch.flush(log)
    return monitor.read_events(spark, log)


QUERIES["u07_measured_jobs"] = lambda spark, sf_dir: measured_jobs(spark, sf_dir).select("op", "success", "rows", "counts", (F.col("duration") > 0).alias("timed"), F.col("error").isNotNull().alias("told"))
ORACLES["u07_measured_jobs"] = """WITH lines AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT 'lines' AS op, true AS success, count(*) AS rows, '{"filled": ' || count(*) FILTER (trim(line) <> '') || '}' AS counts, true AS timed, false AS told FROM lines
UNION ALL SELECT 'markdown', true, count(*), '{"found": ' || count(*) FILTER (HOLDS) || '}', true, false FROM documents
UNION ALL SELECT 'classes', true, count(*), '{"tables": ' || count(*) FILTER (length(line) - length(replace(line, '|', '')) >= 3) || '}', true, false FROM lines
UNION ALL SELECT 'broken', false, NULL, '{}', true, true""".replace("HOLDS", D.holds("text", *classify.MARKDOWN))


def streamed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of a stream that recognises the mathematics of all documents, in batches of a few files."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    folder, total = writers.new_folder(spark, "uploads"), docs.count()
    docs.repartition(6).write.parquet(folder)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    out = writers.new_folder(spark, "recognised")
    sink = lambda batch, number: mathx.format_math(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
    found = monitor.run_with_progress(stream, "mathematics", total, sink, writers.new_folder(spark, "progress")).frame(spark)
    written = spark.read.parquet(out).count()
    told = found.agg(F.max("done").alias("done"), F.max("total").alias("total"), F.max("share").alias("share"), F.count_if(F.col("share").between(0, 1)).alias("n_events"), F.min("share").alias("least"))
    return told.select("done", "total", "share", (F.col("n_events") >= 3).alias("several"), (F.col("least") < 1).alias("partial"), F.lit(written).cast("long").alias("written"))


QUERIES["u08_stream_progress"] = streamed_progress
ORACLES["u08_stream_progress"] = "SELECT count(*) AS done, count(*) AS total, 1::DOUBLE AS share, true AS several, true AS partial, count(*) AS written FROM documents"


def streamed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling metrics of all events, which come in several files and out of order."""
    events = corpus.op_events(spark, sf_dir).select("op", "seq", "duration", "success")
    folder, out = writers.new_folder(spark, "calls"), writers.new_folder(spark, "rolling")
    events.repartition(5).write.parquet(folder)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = own.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    rolling.rolling_metrics(stream, expected={"click": 10**6}).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", writers.new_folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    found = rolling.newest(spark.read.schema(rolling.STATE + ", batch int").parquet(out).drop("batch"))
    return found.select("op", "calls", "errors", F.round("total_time", 6).alias("total_time"), F.round("recent_avg", 6).alias("recent_avg"), "remaining", F.round("seconds_left", 3).alias("seconds_left"))


QUERIES["w04b_rolling_stream"] = streamed_metrics
ORACLES["w04b_rolling_stream"] = """WITH ops AS (SELECT event_type AS op, event_id AS seq, value AS duration, event_id % 7 <> 0 AS success FROM events),
recent AS (SELECT op, avg(duration) AS recent_avg FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY seq DESC) AS r FROM ops WHERE success) WHERE r <= 10 GROUP BY op),
totals AS (SELECT op, count(*) AS calls, count(*) FILTER (NOT success) AS errors, coalesce(sum(duration) FILTER (success), 0) AS total_time FROM ops GROUP BY op)
SELECT op, calls, errors, round(total_time, 6) AS total_time, round(recent_avg, 6) AS recent_avg, CASE WHEN op = 'click' THEN 1000000 - calls END AS remaining, CASE WHEN op = 'click' THEN round((1000000 - calls) * recent_avg, 3) END AS seconds_left FROM totals LEFT JOIN recent USING (op)"""


# table functions of SQL ------------------------------------------------------------


def sql_math_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_functions.register(spark)
    corpus.table(spark, sf_dir, "documents").createOrReplaceTempView("quillspark_documents")
    return spark.sql("SELECT doc_id, begin, end, match, math_type, latex FROM quillspark_documents, LATERAL math_spans(text)")


def sql_job_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_functions.register(spark)
    messages = machine.by_family(job_messages(spark, sf_dir)).withColumn("at", F.unix_micros("at"))
    messages.createOrReplaceTempView("quillspark_messages")
    return machine.refused(machine.timed(spark.sql("SELECT * FROM job_steps(TABLE(quillspark_messages), 24)")))


QUERIES["m05c_sql_math_spans"] = sql_math_spans
ORACLES["m05c_sql_math_spans"] = ORACLES["m05b_document_spans"]
QUERIES["x02c_sql_job_steps"] = sql_job_steps
ORACLES["x02c_sql_job_steps"] = ORACLES["x02b_refused"]
