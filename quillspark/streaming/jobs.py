"""Job events folded into job states, and sampling windows; for batch and stream alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import file_problem

#: Later states absorb earlier ones.
RANKS = {"pending": 0, "processing": 1, "completed": 2, "failed": 2, "cancelled": 2}


def job_events(jobs: DataFrame) -> DataFrame:
    """The events that lead to each job's state: created, started a minute later, ended."""
    rank = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    made = F.struct(F.lit("pending").alias("status"), F.col("created_at").alias("at"))
    begun = F.when(rank[F.col("status")] >= 1, F.struct(F.lit("processing").alias("status"), (F.col("created_at") + F.expr("INTERVAL 1 MINUTE")).alias("at")))
    ended = F.when(rank[F.col("status")] >= 2, F.struct(F.col("status").alias("status"), (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("at")))
    return jobs.select("job_id", F.inline(F.array_compact(F.array(made, begun, ended))))


def fold_jobs(events: DataFrame) -> DataFrame:
    """events(job_id, status, at) -> the state of each job.

    Plain aggregates, so the same fold runs over a stream in update mode and
    the order of arrival does not matter.  ``progress`` is that of the state
    alone; ``machine`` keeps what jobs report.
    """
    rank = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])[F.col("status")]
    last = F.max(F.struct(rank.alias("rank"), F.col("at"), F.col("status")))
    state = events.groupBy("job_id").agg(last.alias("last"), F.min("at").alias("created_at"), F.min(F.when(F.col("status") == "processing", F.col("at"))).alias("started_at"))
    progress = F.when(F.col("last.status") == "completed", 1.0).when(F.col("last.status") == "pending", 0.0).otherwise(0.5)
    return state.select("job_id", F.col("last.status").alias("status"), "created_at", "started_at", progress.alias("progress"))


def windowed(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Calls and the longest one of each operation in each window."""
    found = events.groupBy(F.window("ts", width), "op").agg(F.count("*").alias("n"), F.round(F.max("duration"), 6).alias("peak"))
    return found.select(F.col("window.start").alias("begin"), "op", "n", "peak")


# From which states a request is allowed, and the state that follows.
REQUESTS = {"cancel": (("pending", "processing"), "cancelled"), "retry": (("failed",), "pending"), "delete": (("pending", "completed", "failed", "cancelled"), "deleted")}


def apply_requests(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """jobs(job_id, status), requests(job_id, action) -> job_id, action, status, accepted, problem, new_job_id.

    A request that the job's state does not allow, or for a job that is not
    there, changes nothing and says why; a retry makes a job of its own.
    Each request is judged against the state given; ``machine.fold_messages``
    judges requests for one job one after another.
    """
    found = requests.join(jobs.select("job_id", F.col("status").alias("was")), "job_id", "left")
    allowed, follows = F.lit(False), F.lit(None).cast("string")
    for action, (states, state) in REQUESTS.items():
        fits = (F.col("action") == action) & F.col("was").isin(*states)
        allowed, follows = allowed | F.coalesce(fits, F.lit(False)), F.when(fits, state).otherwise(follows)
    problem = F.when(F.col("was").isNull(), "not found").when(~allowed, F.concat(F.lit("cannot "), "action", F.lit(" a job that is "), "was"))
    retried = F.when(allowed & (F.col("action") == "retry"), F.concat(F.col("job_id").cast("string"), F.lit("-retry")))
    status = F.when(allowed & (F.col("action") != "retry"), follows).otherwise(F.col("was"))
    return found.select("job_id", "action", status.alias("status"), allowed.alias("accepted"), problem.alias("problem"), retried.alias("new_job_id"))


def progress(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs(job_id, status, progress, started_at) -> progress within 0 and 1, and the seconds left of those under way."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress")))
    elapsed = (F.unix_timestamp(now) - F.unix_timestamp("started_at")).cast("double")
    left = F.when((F.col("status") == "processing") & (share > 0), F.greatest(F.lit(0.0), elapsed / share - elapsed))
    return jobs.select("job_id", "status", share.alias("progress"), F.round(left, 6).alias("seconds_left"))


def live_jobs(events: DataFrame, ttl: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """events(event_id, job_id, status, at), a stream or a table -> each event once, for as long as it is kept.

    A stream forgets events older than ``late`` behind the newest, so a
    repeated one is told apart only within that time; ``ttl`` bounds windows
    of jobs, whose state goes with the watermark.
    """
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return once.withColumn("expires_at", F.col("at") + F.expr(f"INTERVAL {ttl}"))


def active_by_window(events: DataFrame, width: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Events and jobs of each window of time.

    In a stream a window is final once the watermark has passed it, and its
    jobs are counted approximately; over a table they are counted exactly.
    """
    jobs = F.approx_count_distinct("job_id") if events.isStreaming else F.count_distinct("job_id")
    own = events.withWatermark("at", late) if events.isStreaming else events
    found = own.groupBy(F.window("at", width)).agg(F.count("*").alias("events"), jobs.alias("jobs"))
    return found.select(F.col("window.start").alias("begin"), "events", "jobs")


def convert_uploads(spark: SparkSession, folder: str, convert: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, pattern: str = "*.pdf", max_files: int = 100):
    """A stream over the files of a folder: each batch is validated, converted and appended to ``output``.

    ``convert`` turns rows (path, content, error) into the rows to write;
    files with an error reach it too, so that it may report them.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)
    checked = found.select("path", "content", file_problem(F.col("path"), F.col("length"), F.col("content")).alias("error"))

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is made again after a failure replaces its own part
        convert(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return checked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttle_windows(samples: DataFrame, width: str = "5 seconds", max_cpu: float = 80.0, max_memory: float = 80.0) -> DataFrame:
    """samples(ts, cpu, memory) -> the peaks of each window, and whether work is throttled in it."""
    found = samples.groupBy(F.window("ts", width)).agg(F.max("cpu").alias("cpu"), F.max("memory").alias("memory"))
    return found.select(F.col("window.start").alias("begin"), "cpu", "memory", ((F.col("cpu") > max_cpu) | (F.col("memory") > max_memory)).alias("throttled"))
