"""What runs is measured: operation events of batch jobs, progress of streams.

Counts come from observed metrics, so they cost no pass of their own.  Events
have the columns that the metrics operators take (op, seq, duration,
success), and go to an append-only log of JSON lines.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

EVENT = "op string, seq long, at timestamp, duration double, success boolean, rows long, error string, counts string"
PROGRESS = "name string, batch long, done long, total long, share double, rows_per_second double"


class Recorder:
    """Runs jobs and keeps an event of each: its time, whether it succeeded, and counts of the rows that went through."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.events = spark, []

    def run(self, op: str, frame: DataFrame, sink: Callable[[DataFrame], object], **counts: Column) -> object:
        """sink(frame), measured; ``counts`` are aggregates over the rows that the sink was given.

        A failure is recorded and raised again.
        """
        seen = Observation(f"{op}-{len(self.events)}")
        watched = frame.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()])
        began, at = time.monotonic(), time.time()
        try:
            out = sink(watched)
        except Exception as failure:
            self._add(op, at, began, None, f"{type(failure).__name__}: {failure}".split("\n")[0])
            raise
        self._add(op, at, began, seen.get, None)
        return out

    def measured(self, op: str, sink: Callable[[DataFrame], object], **counts: Column) -> Callable:
        """A decorator for functions that return a DataFrame: calling them runs the sink on it and gives what the sink gives."""

        def around(make: Callable[..., DataFrame]) -> Callable[..., object]:
            @wraps(make)
            def call(*args, **options) -> object:
                return self.run(op, make(*args, **options), sink, **counts)

            return call

        return around

    def _add(self, op: str, at: float, began: float, counts: dict | None, error: str | None) -> None:
        rows = counts.pop("rows") if counts else None
        self.events.append((op, len(self.events), at, time.monotonic() - began, error is None, rows, error, json.dumps(counts or {}, sort_keys=True, default=str)))

    def frame(self) -> DataFrame:
        """The events so far; one row for each job that was run."""
        found = self.spark.createDataFrame(self.events, EVENT.replace("at timestamp", "at double"))
        return found.withColumn("at", F.timestamp_seconds("at"))

    def flush(self, path: str) -> None:
        """Append the events to the log and forget them."""
        if self.events:
            self.frame().select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(path)
            self.events = []


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


class ProgressListener(StreamingQueryListener):
    """Tells how far the streams of the given names are, as (name, rows so far, rows in all) after each batch.

    ``totals`` has the rows that each stream is to get in all, where that is
    known.  The callback runs on the driver; progress stays within 0 and 1,
    and the last call of a stream that ends well says that it is complete.
    """

    def __init__(self, totals: dict[str, int | None], callback: Callable[[int, int | None, str], None] | None = None) -> None:
        self.totals, self.callback = totals, callback
        self.rows: list[tuple] = []
        self.done: dict[str, int] = {}
        self.names: dict[str, str] = {}
        self.ended = threading.Condition()
        self.finished: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        if event.name in self.totals:
            self.names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name in self.totals:
            self._tell(p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.get(str(event.id))
        if name is None:
            return
        with self.ended:
            self.finished[name] = event.exception
            self.ended.notify_all()

    def _tell(self, name: str, batch: int, rows: int, pace: float) -> None:
        done, total = self.done.get(name, 0) + rows, self.totals[name]
        self.done[name] = done
        share = None if total is None else 1.0 if total <= 0 else min(1.0, done / total)
        self.rows.append((name, batch, done, total, share, float(pace)))
        if self.callback:
            self.callback(done, total, name)

    def wait(self, name: str, seconds: float = 60.0) -> bool:
        """Whether the stream has ended and all its progress has come."""
        with self.ended:
            return self.ended.wait_for(lambda: name in self.finished, seconds)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, PROGRESS)


def run_with_progress(stream: DataFrame, name: str, total: int | None, sink: Callable[[DataFrame, int], None], checkpoint: str, callback: Callable[[int, int | None, str], None] | None = None) -> ProgressListener:
    """Run a stream over what is there, batch by batch, and give its progress; a failure of a batch is raised."""
    spark = stream.sparkSession
    listener = ProgressListener({name: total}, callback)
    spark.streams.addListener(listener)
    try:
        query = stream.writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        listener.wait(name)
    finally:
        spark.streams.removeListener(listener)
    return listener
