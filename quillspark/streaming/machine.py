"""Jobs as a keyed state machine: messages in, accepted and refused transitions out.

The same transitions run over a table (a fold over rows sorted by family) and
over a stream (state in the store, timers by event time).  A stream holds
messages until the watermark has passed them and applies them in the order of
their times, so it gives what the fold gives, in whatever order they came
within the watermark's delay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The states in which a job has ended, and those in which each request is allowed.
ENDED = ("completed", "failed", "cancelled")
ALLOWED = {"update": ("pending", "processing"), "cancel": ("pending", "processing"), "retry": ("failed",), "delete": ("pending", "completed", "failed", "cancelled")}
CANCELLED, QUEUED = "Job cancelled by user request", "Job queued for retry"
HOUR = 3_600_000_000

#: A message: ``seq`` tells messages of one time and job family apart; ``status``, ``progress``, ``message`` and ``error`` belong to updates.
MESSAGE = "job_id string, seq long, at timestamp, action string, status string, progress double, message string, error string"
STEP = "job_id string, seq long, at timestamp, action string, accepted boolean, problem string, new_job_id string, status string, progress double, started_at timestamp, completed_at timestamp, message string, error string"
NAMES = [x.split()[0] for x in STEP.split(", ")]


@dataclass
class Job:
    """Times are microseconds."""

    status: str = "pending"
    progress: float = 0.0
    started_at: int | None = None
    completed_at: int | None = None
    message: str | None = None
    error: str | None = None
    retries: int = 0

    def update(self, at: int, status: str | None, progress: float | None, message: str | None, error: str | None) -> None:
        """``started_at`` is set once, ``completed_at`` with the end; progress stays within 0 and 1."""
        self.status = status or self.status
        if self.status in ENDED:
            self.completed_at = at
        elif self.status == "processing" and self.started_at is None:
            self.started_at = at
        if progress is not None:
            self.progress = min(1.0, max(0.0, progress))
        self.message = message if message is not None else self.message
        self.error = error if error is not None else self.error


class Family:
    """The jobs of one family: a job and the ones that its retries made."""

    def __init__(self, jobs: dict[str, Job] | None = None, ttl: int = 24 * HOUR) -> None:
        self.jobs, self.ttl = jobs or {}, ttl

    def row(self, job_id: str, seq: int | None, at: int, action: str, problem: str | None, new: str | None = None, gone: Job | None = None) -> tuple:
        job = gone or self.jobs.get(job_id) or Job(status=None, progress=None)
        return (job_id, seq, at, action, problem is None, problem, new, job.status, job.progress, job.started_at, job.completed_at, job.message, job.error)

    def expiries(self) -> list[tuple[int, str]]:
        """When each job that has ended is to go, in order."""
        return sorted((j.completed_at + self.ttl, k) for k, j in self.jobs.items() if j.completed_at is not None)

    def expire(self, until: int) -> Iterator[tuple]:
        """Jobs that ended more than the time to live before ``until`` go."""
        for at, job_id in self.expiries():
            if at < until:
                yield self.row(job_id, None, at, "expired", None, gone=self.jobs.pop(job_id))

    def apply(self, job_id: str, seq: int, at: int, action: str, status: str | None, progress: float | None, message: str | None, error: str | None) -> Iterator[tuple]:
        """What a message does: what expires before it, and one accepted or refused step."""
        yield from self.expire(at)
        job = self.jobs.get(job_id)
        if action == "create":
            problem = "already there" if job else None
            self.jobs.setdefault(job_id, Job())
            yield self.row(job_id, seq, at, action, problem)
        elif job is None:
            yield self.row(job_id, seq, at, action, "not found")
        elif job.status not in ALLOWED.get(action, ()):
            yield self.row(job_id, seq, at, action, f"cannot {action} a job that is {job.status}")
        elif action == "delete":
            yield self.row(job_id, seq, at, action, None, gone=self.jobs.pop(job_id))
        elif action == "retry":
            job.retries += 1
            new = f"{job_id}-retry-{job.retries}"
            self.jobs[new] = Job(message=QUEUED)
            yield self.row(job_id, seq, at, action, None, new)
        else:
            job.update(at, "cancelled" if action == "cancel" else status, progress, CANCELLED if action == "cancel" else message, error)
            yield self.row(job_id, seq, at, action, None)


def by_family(messages: DataFrame) -> DataFrame:
    """Messages with their family: the id without the marks of retries."""
    return messages.withColumn("family", F.regexp_replace("job_id", "(-retry-[0-9]+)+$", ""))


def micros(name: str):
    return F.unix_micros(name).alias(name)


def timed(steps: DataFrame) -> DataFrame:
    return steps.select(*[F.timestamp_micros(n).alias(n) if n in ("at", "started_at", "completed_at") else n for n in NAMES])


COUNTED = STEP.replace("timestamp", "long")


def fold_messages(messages: DataFrame, ttl_hours: float = 24, until: str | None = None) -> DataFrame:
    """messages (MESSAGE) -> every step (STEP) of every job, as a table.

    A message that is repeated with its time and ``seq`` counts once; messages
    without a job, time or number are left out.  With ``until``, jobs that have
    expired by then are told, too.  A task holds the jobs of one family at a
    time.  An empty table gives an empty result.
    """
    ttl = int(ttl_hours * HOUR)
    end = F.unix_micros(F.lit(until).cast("timestamp")) if until else F.lit(None).cast("long")
    own = by_family(messages.where("job_id IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL"))
    fields = ["job_id", "seq", micros("at"), "action", "status", "progress", "message", "error"]
    rows = own.select("family", *fields, end.alias("until")).repartition("family").sortWithinPartitions("family", "at", "seq", "job_id", "action")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, family, last, last_until = None, Family(ttl=ttl), None, None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(NAMES)}, pa.schema(ARROW))

        for batch in batches:
            out: list[tuple] = []
            for own_name, *message, until_at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own_name != name:
                    out += family.expire(last_until) if last_until else ()
                    name, family, last = own_name, Family(ttl=ttl), None
                place = (message[0], message[1], message[2])
                if place != last:
                    out += family.apply(*message)
                last, last_until = place, until_at
            yield batch_of(out)
        yield batch_of(list(family.expire(last_until)) if last_until else [])

    return timed(rows.mapInArrow(run, COUNTED))


KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
ARROW = [(n, KINDS[k]) for n, k in (x.split() for x in COUNTED.split(", "))]


class JobProcessor(StatefulProcessor):
    """A family's jobs and the messages that the watermark has not passed."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "jobs string")
        self.held = handle.getMapState("held", "at long, seq long, job_id string", "message string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for message in json.loads(frame[["job_id", "seq", "at_micros", *MESSAGE_FIELDS[3:]]].to_json(orient="values", double_precision=15)):
                at, seq, job_id = message[2], message[1], message[0]
                if not self.held.containsKey((at, seq, job_id)):
                    self.held.updateValue((at, seq, job_id), (json.dumps(message),))
                    self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed is applied in order; the next expiry gets a timer of its own."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        stored = json.loads(self.jobs.get()[0]) if self.jobs.exists() else {}
        family, out = Family({k: Job(**j) for k, j in stored.items()}, self.ttl), []
        due = sorted((tuple(k), v[0]) for k, v in self.held.iterator() if k[0] <= passed)
        for place, message in due:
            out += family.apply(*json.loads(message))
            self.held.removeKey(place)
        out += family.expire(passed)
        for at, _ in family.expiries()[:1]:
            self.handle.registerTimer(at // 1000 + 1)
        if family.jobs:
            self.jobs.update((json.dumps({k: asdict(j) for k, j in family.jobs.items()}),))
        else:
            self.jobs.clear()
        if out:
            # nullable types: a number that is missing stays missing
            yield pd.DataFrame({n: pd.array([r[k] for r in out], dtype=PANDAS[kind]) for k, (n, kind) in enumerate(x.split() for x in COUNTED.split(", "))})

    def close(self) -> None:
        pass


MESSAGE_FIELDS = [x.split()[0] for x in MESSAGE.split(", ")]
PANDAS = {"string": "object", "long": "Int64", "boolean": "bool", "double": "Float64"}


def run_messages(messages: DataFrame, ttl_hours: float = 24, late: str = "1 hour") -> DataFrame:
    """A stream of messages (MESSAGE) -> a stream of steps (STEP), each once the watermark has passed it.

    Messages come in any order, and repeated, within ``late`` of the newest;
    later ones are dropped.  A family's state goes when its last job is deleted
    or has expired.  The session needs the RocksDB state store.
    """
    own = by_family(messages.where("job_id IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL").withWatermark("at", late))
    fields = [F.unix_micros("at").alias("at_micros") if n == "at" else F.col(n) for n in MESSAGE_FIELDS]
    frame = own.select("family", "at", *fields)
    return timed(frame.groupBy("family").transformWithStateInPandas(JobProcessor(int(ttl_hours * HOUR)), COUNTED, "append", "eventtime"))


def current_jobs(steps: DataFrame) -> DataFrame:
    """steps (STEP) -> job_id, status, progress, started_at, completed_at, message, error of the jobs that are there."""
    made = steps.where("accepted").select(F.explode(F.array_compact(F.array(F.struct("job_id", "at", "seq", F.lit(1).alias("own"), "action", "status", "progress", "started_at", "completed_at", "message", "error"), F.when(F.col("new_job_id").isNotNull(), F.struct(F.col("new_job_id").alias("job_id"), "at", "seq", F.lit(0).alias("own"), F.lit("create").alias("action"), F.lit("pending").alias("status"), F.lit(0.0).alias("progress"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(QUEUED).alias("message"), F.lit(None).cast("string").alias("error")))))).alias("s"))
    last = made.select("s.*").groupBy("job_id").agg(F.max_by(F.struct("action", "status", "progress", "started_at", "completed_at", "message", "error"), F.struct("at", F.coalesce("seq", F.lit(2**62)), "own")).alias("last"))
    return last.where("last.action NOT IN ('delete', 'expired')").select("job_id", "last.status", "last.progress", "last.started_at", "last.completed_at", "last.message", "last.error")


def refused(steps: DataFrame) -> DataFrame:
    """The side output: requests and updates that were not allowed, and why."""
    return steps.where("NOT accepted").select("job_id", "seq", "at", "action", "problem")
