"""Queries of operations, resources, jobs, caches, engines and model calls, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference, metrics
from ..sinks import store, writers
from ..sources import corpus
from ..streaming import jobs as job_stream
from .queries import ORACLES, QUERIES, V, over_cache, over_events, over_jobs, page_requests, query

col = F.col

# operations and resources --------------------------------------------------


def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory and CPU samples of operations, one of each for every event."""
    e = corpus.table(spark, sf_dir, "events")
    kinds = F.array(F.struct(F.lit("memory").alias("kind"), (col("event_id") % 1100 + 0.5).alias("value")), F.struct(F.lit("cpu").alias("kind"), (col("event_id") % 79 + 0.25).alias("value")))
    return e.select(col("event_type").alias("op"), F.inline(kinds))


R = """samples AS (SELECT event_type AS op, 'memory' AS kind, event_id % 1100 + 0.5::DOUBLE AS value FROM events UNION ALL SELECT event_type, 'cpu', event_id % 79 + 0.25::DOUBLE FROM events),
resources AS (SELECT op, kind, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min, count(*) AS samples FROM samples GROUP BY op, kind)
"""
SUMMARY = """totals AS (SELECT CAST(sum(calls) AS BIGINT) AS total_operations, CAST(sum(errors) AS BIGINT) AS total_errors, round((sum(calls) - sum(errors)) / sum(calls)::DOUBLE, 6) AS overall_success_rate, count(*) AS unique_operations FROM metrics),
slow AS (SELECT string_agg(op, ',' ORDER BY avg_time DESC, op) AS slowest FROM (SELECT * FROM metrics ORDER BY avg_time DESC, op LIMIT 3)),
often AS (SELECT string_agg(op || ':' || calls, ',' ORDER BY calls DESC, op) AS frequent FROM (SELECT * FROM metrics ORDER BY calls DESC, op LIMIT 3))
"""


def shown_summary(m: DataFrame) -> DataFrame:
    s = metrics.summary(m, 3)
    names = F.array_join(F.transform("slowest_operations", lambda x: x["op"]), ",")
    counts = F.array_join(F.transform("most_frequent_operations", lambda x: F.concat(x["op"], F.lit(":"), x["calls"].cast("string"))), ",")
    return s.select("total_operations", "total_errors", "overall_success_rate", "unique_operations", names.alias("slowest"), counts.alias("frequent"))


over_events("a17_summary", lambda e: shown_summary(metrics.operation_metrics(e)), ", " + SUMMARY + "SELECT * FROM totals, slow, often")
over_events("a17_slowest", lambda e: metrics.slowest(metrics.operation_metrics(e), 3), "SELECT op, avg_time FROM metrics ORDER BY avg_time DESC, op LIMIT 3")
QUERIES["a18_resource_summary"] = lambda spark, sf_dir: metrics.resource_summary(resource_samples(spark, sf_dir))
ORACLES["a18_resource_summary"] = "WITH " + R + "SELECT * FROM resources"
ADVICE = """advice AS (SELECT op, 'slow' AS advice, avg_time AS value FROM metrics WHERE avg_time > 5 UNION ALL SELECT op, 'unreliable', success_rate FROM metrics WHERE success_rate < 0.95::DOUBLE
UNION ALL SELECT op, 'high ' || kind, max FROM resources WHERE kind = 'memory' AND max > 1000 OR kind = 'cpu' AND max > 80)
"""


def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recommendations(metrics.operation_metrics(corpus.op_events(spark, sf_dir)), metrics.resource_summary(resource_samples(spark, sf_dir)))


QUERIES["a19_recommendations"] = advice
ORACLES["a19_recommendations"] = V + ", " + R + ", " + ADVICE + "SELECT * FROM advice"
QUERIES["a19_all_fine"] = lambda spark, sf_dir: metrics.recommendations(metrics.operation_metrics(corpus.op_events(spark, sf_dir).where("success").withColumn("duration", F.least("duration", F.lit(4.0)))), metrics.resource_summary(resource_samples(spark, sf_dir).where("kind = 'cpu'")))
ORACLES["a19_all_fine"] = "SELECT CAST(NULL AS VARCHAR) AS op, 'fine' AS advice, CAST(NULL AS DOUBLE) AS value WHERE NOT EXISTS (SELECT 1 FROM (SELECT event_type, avg(least(value, 4)) AS a, max(event_id % 79 + 0.25) AS c FROM events WHERE event_id % 7 <> 0 GROUP BY 1) WHERE a > 5 OR c > 80)"


@query("a20_batch_statistics", """WITH r AS (SELECT user_id % 50 AS batch, event_id % 7 <> 0 AS success, epoch(date_trunc('second', ts)) AS began, epoch(date_trunc('second', ts)) + event_id % 9 AS ended FROM events),
b AS (SELECT batch, count(*) AS items, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, max(ended) - min(began) AS wall FROM r GROUP BY batch)
SELECT batch, items, succeeded, failed, round(100 * succeeded / items::DOUBLE, 4) AS success_percent, round(CASE WHEN wall > 0 THEN succeeded / wall ELSE 0 END, 6) AS throughput, round(CASE WHEN succeeded > 0 THEN wall / succeeded ELSE 0 END, 6) AS avg_seconds FROM b""")  # fmt: skip
def batch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    began = F.unix_timestamp("ts")
    rows = corpus.table(spark, sf_dir, "events").select((col("user_id") % 50).alias("batch"), (col("event_id") % 7 != 0).alias("success"), began.alias("began"), (began + col("event_id") % 9).alias("ended"))
    return metrics.batch_statistics(rows)


@query("a24_health", "SELECT n_regionkey AS service, CASE WHEN bool_or(n_nationkey % 7 = 3) THEN 'healthy' ELSE 'degraded' END AS status FROM nation GROUP BY 1")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.health(corpus.table(spark, sf_dir, "nation").select(col("n_regionkey").alias("service"), (col("n_nationkey") % 7 == 3).alias("connected")))


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "events").select("event_id", "ts", (col("event_id") % 101).cast("double").alias("cpu"), (col("user_id") % 97).cast("double").alias("memory"))


QUERIES["a25_throttled"] = lambda spark, sf_dir: metrics.throttled(load(spark, sf_dir)).select("event_id", "throttled")
ORACLES["a25_throttled"] = "SELECT event_id, event_id % 101 > 80 OR user_id % 97 > 80 AS throttled FROM events"
QUERIES["x06_throttle_windows"] = lambda spark, sf_dir: job_stream.throttle_windows(load(spark, sf_dir), "10 minutes", 99, 95)
ORACLES["x06_throttle_windows"] = "SELECT time_bucket(INTERVAL '10 minutes', ts) AS begin, CAST(max(event_id % 101) AS DOUBLE) AS cpu, CAST(max(user_id % 97) AS DOUBLE) AS memory, max(event_id % 101) > 99 OR max(user_id % 97) > 95 AS throttled FROM events GROUP BY 1"
QUERIES["a26_first_of_each"] = lambda spark, sf_dir: metrics.first_of_each(corpus.table(spark, sf_dir, "events"), "user_id", "event_id")
ORACLES["a26_first_of_each"] = "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1"
QUERIES["o06_first_few"] = lambda spark, sf_dir: metrics.first_few(corpus.table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")
ORACLES["o06_first_few"] = "SELECT * FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS place FROM events) WHERE place <= 5"
QUERIES["w06_seconds_left"] = lambda spark, sf_dir: corpus.table(spark, sf_dir, "events").select("event_id", F.round(inference.seconds_left(col("event_id") * 0.5, col("event_id") % 1000, F.lit(1000)), 6).alias("seconds_left"))
ORACLES["w06_seconds_left"] = "SELECT event_id, CASE WHEN event_id % 1000 > 0 THEN round(greatest(0::DOUBLE, event_id * 0.5::DOUBLE * 1000 / (event_id % 1000) - event_id * 0.5::DOUBLE), 6) END AS seconds_left FROM events"

# reports and logs ------------------------------------------------------------


@query("k04_metrics_export", V + "SELECT CAST(sum(calls) AS BIGINT) AS total, count(*) AS n, string_agg(op, ',' ORDER BY op) AS ops FROM metrics")
def metrics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as a JSON file, read back."""
    m = metrics.operation_metrics(corpus.op_events(spark, sf_dir))
    folder = writers.new_folder(spark, "metrics")
    writers.write_json_lines(writers.metrics_export(m, metrics.summary(m), F.lit(0)), folder)
    found = spark.read.schema("summary struct<total_operations:long>, detailed_metrics array<struct<op:string>>").json(folder)
    return found.select(col("summary.total_operations").alias("total"), F.size("detailed_metrics").cast("long").alias("n"), F.array_join(F.transform("detailed_metrics", lambda x: x["op"]), ",").alias("ops"))


@query("k05_performance_report", V + ", " + R + ", " + ADVICE + "SELECT (SELECT CAST(sum(errors) AS BIGINT) FROM metrics) AS errors, (SELECT count(*) FROM resources) AS resources, (SELECT count(*) FROM advice) AS advice, 4 AS workers")
def performance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as a JSON file, read back."""
    m = metrics.operation_metrics(corpus.op_events(spark, sf_dir))
    folder = writers.new_folder(spark, "report")
    report = writers.performance_report(m, metrics.summary(m), metrics.resource_summary(resource_samples(spark, sf_dir)), advice(spark, sf_dir), F.lit(0), {"cache_enabled": True, "max_workers": 4})
    writers.write_json_lines(report, folder)
    schema = "performance_summary struct<total_errors:long>, resource_summary array<struct<op:string>>, optimization_recommendations array<struct<op:string>>, configuration struct<max_workers:int>"
    found = spark.read.schema(schema).json(folder)
    return found.select(col("performance_summary.total_errors").alias("errors"), F.size("resource_summary").cast("long").alias("resources"), F.size("optimization_recommendations").cast("long").alias("advice"), col("configuration.max_workers").alias("workers"))


@query("k09_log_events", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS at, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'performance' END AS event_type, CASE WHEN event_id % 7 = 0 THEN 'errors' ELSE 'performance' END AS logger, CASE WHEN event_id % 7 = 0 THEN 'Error in operation ''' || event_type || ''': late' ELSE 'Operation ''' || event_type || ''' completed in ' || (event_id % 50) || '.500s' END AS message FROM events")
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance and error events as a JSON log, read back."""
    e = corpus.table(spark, sf_dir, "events")
    line = F.when(col("event_id") % 7 == 0, writers.error_event(col("ts"), col("event_type"), F.lit("late"))).otherwise(writers.performance_event(col("ts"), col("event_type"), col("event_id") % 50 + 0.5))
    folder = writers.new_folder(spark, "log")
    writers.write_json_lines(e.select(F.concat(F.lit('{"event_id":'), col("event_id").cast("string"), F.lit(","), F.substring(line, F.lit(2), F.length(line))).alias("value")), folder)
    found = spark.read.schema("event_id long, timestamp string, event_type string, logger string, message string").json(folder)
    return found.select("event_id", F.left("timestamp", F.lit(19)).alias("at"), "event_type", "logger", "message")


@query("k09b_request_events", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'system_disk' ELSE 'request' END AS event_type, CASE WHEN event_id % 5 = 0 THEN 'system' ELSE 'requests' END AS logger, CASE WHEN event_id % 5 = 0 THEN 'Disk of ' || user_id || ' is full' ELSE 'Request r' || event_id || ': ' || event_type || ' - ' || CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'error' ELSE 'timeout' END END AS message, CASE WHEN event_id % 5 > 0 THEN CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'error' ELSE 'timeout' END END AS status, CASE WHEN event_id % 5 > 0 THEN value END AS duration, CASE WHEN event_id % 5 = 0 THEN user_id END AS disk FROM events")
def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and events of the system as a JSON log, read back."""
    e = corpus.table(spark, sf_dir, "events")
    number = F.concat(F.lit("r"), col("event_id").cast("string"))
    status = F.element_at(F.array(*map(F.lit, ("success", "error", "timeout"))), (col("event_id") % 3 + 1).cast("int"))
    request = writers.request_event(col("ts"), number, col("event_type"), status, col("value"), event_id=col("event_id"))
    system = writers.system_event(col("ts"), "disk", F.concat(F.lit("Disk of "), col("user_id").cast("string"), F.lit(" is full")), disk=col("user_id"), event_id=col("event_id"))
    folder = writers.new_folder(spark, "requests")
    writers.write_json_lines(e.select(F.when(col("event_id") % 5 == 0, system).otherwise(request).alias("value")), folder)
    return spark.read.schema("event_id long, event_type string, logger string, message string, status string, duration double, disk long").json(folder)


# jobs ---------------------------------------------------------------------------


def job_requests(j: DataFrame) -> DataFrame:
    """Requests for jobs in every state, and for some that are not there."""
    action = F.when(col("job_id") % 5 < 2, "cancel").when(col("job_id") % 5 < 4, "retry").otherwise("delete")
    return j.select(F.when(col("job_id") % 11 == 0, -1 - col("job_id")).otherwise(col("job_id")).alias("job_id"), action.alias("action"))


over_jobs("x02_requests", lambda j: job_stream.apply_requests(j, job_requests(j)), """, r AS (SELECT CASE WHEN job_id % 11 = 0 THEN -1 - job_id ELSE job_id END AS job_id, CASE WHEN job_id % 5 < 2 THEN 'cancel' WHEN job_id % 5 < 4 THEN 'retry' ELSE 'delete' END AS action, CASE WHEN job_id % 11 <> 0 THEN status END AS was FROM jobs),
k AS (SELECT *, coalesce(CASE action WHEN 'cancel' THEN was IN ('pending', 'processing') WHEN 'retry' THEN was = 'failed' ELSE was <> 'processing' END, false) AS ok FROM r)
SELECT job_id, action, CASE WHEN ok AND action = 'cancel' THEN 'cancelled' WHEN ok AND action = 'delete' THEN 'deleted' ELSE was END AS status, ok AS accepted, CASE WHEN was IS NULL THEN 'not found' WHEN NOT ok THEN 'cannot ' || action || ' a job that is ' || was END AS problem, CASE WHEN ok AND action = 'retry' THEN job_id || '-retry' END AS new_job_id FROM k""")  # fmt: skip
NOW = "2000-01-01 00:00:00"
over_jobs("x03_progress", lambda j: job_stream.progress(j.select("job_id", "status", ((col("job_id") % 14 - 1) / 10).alias("progress"), col("created_at").alias("started_at")), F.lit(NOW).cast("timestamp")), f""", p AS (SELECT job_id, status, greatest(0, least(1, (job_id % 14 - 1) / 10::DOUBLE)) AS progress, epoch(TIMESTAMP '{NOW}') - epoch(created_at) AS elapsed FROM jobs)
SELECT job_id, status, progress, CASE WHEN status = 'processing' AND progress > 0 THEN round(greatest(0, elapsed / progress - elapsed), 6) END AS seconds_left FROM p""")  # fmt: skip


def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events").select("event_id", col("user_id").alias("job_id"), col("event_type").alias("status"), col("ts").alias("at"))
    return e.unionByName(e.where("event_id % 3 = 0"))


QUERIES["x04_live_jobs"] = lambda spark, sf_dir: job_stream.live_jobs(repeated_events(spark, sf_dir))
ORACLES["x04_live_jobs"] = "SELECT event_id, user_id AS job_id, event_type AS status, ts AS at, ts + INTERVAL 24 HOURS AS expires_at FROM events"
QUERIES["x04_active_windows"] = lambda spark, sf_dir: job_stream.active_by_window(repeated_events(spark, sf_dir))
ORACLES["x04_active_windows"] = "SELECT time_bucket(INTERVAL '24 hours', ts) AS begin, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS events, count(DISTINCT user_id) AS jobs FROM events GROUP BY 1"

# caches and engines -----------------------------------------------------------------

over_cache("w08_oldest_to_share", lambda c: metrics.oldest_to_share(c, 250_000, 0.8, bucket=10_000), "SELECT cache, entry_id, size_bytes FROM (SELECT *, sum(size_bytes) OVER (PARTITION BY cache) AS used, coalesce(sum(size_bytes) OVER (PARTITION BY cache ORDER BY last_access, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM entries) WHERE used > 250000 AND used - freed > 200000")


def looked_through(c: DataFrame, which: int) -> DataFrame:
    side = lambda n: c.where(f"entry_id % {n} = 0").select("key", col("entry_id").alias("value"))
    return metrics.look_through(c.select("key", "entry_id"), side(3), side(2), lambda rows: rows.select("key", (-col("entry_id")).alias("value")))[which]


over_cache("j04_look_through", lambda c: looked_through(c, 0), "SELECT key, CASE WHEN entry_id % 3 = 0 OR entry_id % 2 = 0 THEN entry_id ELSE -entry_id END AS value, CASE WHEN entry_id % 3 = 0 THEN 'memory' WHEN entry_id % 2 = 0 THEN 'store' ELSE 'computed' END AS tier FROM entries")


def stored_results(spark: SparkSession, sf_dir: str) -> store.Store:
    """A store that holds two generations of results for two in three documents' texts."""
    found = store.create(spark, writers.new_folder(spark, "store"), 16)
    texts = corpus.table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.max("doc_id").alias("doc_id")).where("doc_id % 3 > 0")
    for word, day in (("old ", "2024-01-01"), ("new ", "2024-01-02")):
        own = texts if word == "old " else texts.where("doc_id % 2 = 0")
        found.put(own.select("key", F.concat(F.lit(word), col("doc_id").cast("string")).alias("value"), F.lit(day).cast("timestamp").alias("stored_at")))
    return found


STORED = "stored AS (SELECT key, CASE WHEN doc_id % 2 = 0 THEN 'new ' ELSE 'old ' END || doc_id AS value, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END AS stored_at FROM (SELECT sha256(text) AS key, max(doc_id) AS doc_id FROM documents GROUP BY 1) WHERE key IS NOT NULL AND doc_id % 3 > 0)"
QUERIES["k06b_bucketed_store"] = lambda spark, sf_dir: stored_results(spark, sf_dir).newest()
ORACLES["k06b_bucketed_store"] = f"WITH {STORED} SELECT key, value, CAST(strlen(value) AS BIGINT) AS size_bytes, stored_at FROM stored"
QUERIES["j04b_store_join"] = lambda spark, sf_dir: stored_results(spark, sf_dir).look_up(corpus.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key")))
ORACLES["j04b_store_join"] = f"WITH {STORED} SELECT doc_id, sha256(text) AS key, value, stored_at FROM documents d LEFT JOIN stored s ON sha256(d.text) = s.key"
over_cache("j04_promoted", lambda c: looked_through(c, 1), "SELECT key, CASE WHEN entry_id % 3 = 0 OR entry_id % 2 = 0 THEN entry_id ELSE -entry_id END AS value FROM entries")


@query("j05_named_models", "SELECT upper(n_name) AS name, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey END AS n_nationkey FROM nation")
def named_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus.table(spark, sf_dir, "nation")
    return metrics.named(n.select(F.upper("n_name").alias("name")), n.where("n_nationkey % 4 > 0").select(F.lower("n_name").alias("name"), "n_nationkey"))


@query("j06_configured", "SELECT n_name AS backend, n_nationkey % 4 = 1 AS enabled, CASE WHEN n_nationkey % 4 > 0 THEN n_regionkey END AS region FROM nation")
def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus.table(spark, sf_dir, "nation")
    settings = n.where("n_nationkey % 4 > 0").select(col("n_name").alias("backend"), (col("n_nationkey") % 4 == 1).alias("enabled"), col("n_regionkey").alias("region"))
    return metrics.configured(n.select(col("n_name").alias("backend")), settings)


@query("j09_chosen_engines", "SELECT c_custkey, c_mktsegment AS engine, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN c_mktsegment ELSE 'MACHINERY' END AS chosen FROM customer")
def chosen_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    engines = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(k).alias("place")) for k, e in enumerate(("MACHINERY", "BUILDING"))])))
    return metrics.chosen_engine(corpus.table(spark, sf_dir, "customer").select("c_custkey", col("c_mktsegment").alias("engine")), engines)


# model calls ----------------------------------------------------------------------------


@query("e02_message_bodies", """SELECT page_id, '{"model":"m","max_tokens":4096,"messages":[{"role":"user","content":[{"type":"image","source":{"type":"base64","media_type":"image/png","data":"' || md5(html) || '"}},{"type":"text","text":"Page ' || page_id || '"}]}]}' AS body FROM pages""")
def message_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id", inference.request_body(F.concat(F.lit("Page "), col("page_id").cast("string")), F.md5("html"), "m", "messages").alias("body"))


REPLIES = ['{{"response":"r{0}","eval_count":{0},"total_duration":3000000000}}', '{{"choices":[{{"message":{{"content":"c{0}"}}}}],"usage":{{"completion_tokens":{0}}}}}', '{{"content":[{{"text":"t{0}"}}],"usage":{{"output_tokens":{0}}}}}', '{{"output":"o{0}","tokens":{0}}}', "plain {0}"]


@query("e03_replies", "SELECT page_id, ['r', 'c', 't', 'o', 'plain '][page_id % 5 + 1] || page_id AS text, CASE WHEN page_id % 5 < 4 THEN page_id END AS tokens, CASE WHEN page_id % 5 = 0 THEN 3::DOUBLE END AS seconds FROM pages")
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("page_id").cast("string")
    bodies = F.array(*[F.replace(F.lit(r.format("@@")), F.lit("@@"), k) for r in REPLIES])
    body = bodies[(col("page_id") % 5).cast("int")]
    return corpus.table(spark, sf_dir, "pages").select("page_id", inference.reply_text(body).alias("text"), inference.reply_tokens(body).alias("tokens"), inference.reply_seconds(body).alias("seconds"))


def upper_or_fail() -> inference.Client:
    """Work without a network: upper case, but for bodies that end in 7."""

    def work(body: str) -> str:
        if body.endswith("7"):
            raise ValueError("seven")
        return body.upper()

    return work


QUERIES["u04_process_items"] = lambda spark, sf_dir: inference.process_items(corpus.table(spark, sf_dir, "pages").select(col("page_id").alias("index"), F.concat(F.lit("page "), col("page_id").cast("string")).alias("body")), "body", upper_or_fail, retries=1, delay=0.0)
ORACLES["u04_process_items"] = "SELECT page_id AS index, page_id % 10 <> 7 AS success, CASE WHEN page_id % 10 <> 7 THEN 'PAGE ' || page_id END AS result, CASE WHEN page_id % 10 = 7 THEN 'ValueError: seven' END AS error, CASE WHEN page_id % 10 = 7 THEN 2 ELSE 1 END AS attempts FROM pages"
QUERIES["u05_process_batches"] = lambda spark, sf_dir: inference.process_batches(page_requests(spark, sf_dir).select(col("page_id").alias("index"), F.col("page_id").cast("string").alias("body")), "body", lambda: lambda bodies: [None if b is None else f"<{b}>" for b in bodies])
ORACLES["u05_process_batches"] = "SELECT page_id AS index, '<' || page_id || '>' AS result FROM pages"
