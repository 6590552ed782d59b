"""Rolling operation metrics of a stream: a ring of recent durations and running counts in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Durations that are kept of each operation, and successes whose mean is told.
RING, LAST = 100, 10
STATE = "op string, calls long, errors long, total_time double, recent_avg double, remaining long, seconds_left double"
EXPECTED_STATE = "seqs array<long>, durations array<double>, calls long, errors long, total double"


class RollingProcessor(StatefulProcessor):
    """Of an operation: counts, and its last successes by number, whatever order they come in."""

    def __init__(self, ring: int, last: int, expected: dict[str, int]) -> None:
        self.ring, self.last, self.expected = ring, last, expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rolling", EXPECTED_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seqs, durations, calls, errors, total = self.state.get() if self.state.exists() else ([], [], 0, 0, 0.0)
        ring = dict(zip(seqs, durations, strict=True))
        for frame in rows:
            good = frame[frame["success"]]
            calls, errors, total = calls + len(frame), errors + len(frame) - len(good), total + float(good["duration"].sum())
            ring.update(zip(good["seq"].tolist(), good["duration"].tolist(), strict=True))
            ring = dict(sorted(ring.items())[-self.ring :])
        self.state.update((list(ring), list(ring.values()), calls, errors, total))
        recent = list(ring.values())[-self.last :]
        average = sum(recent) / len(recent) if recent else None
        left = max(0, self.expected[key[0]] - calls) if key[0] in self.expected else None
        yield pd.DataFrame({"op": [key[0]], "calls": [calls], "errors": [errors], "total_time": [total], "recent_avg": pd.array([average], "Float64"), "remaining": pd.array([left], "Int64"), "seconds_left": pd.array([None if left is None or average is None else left * average], "Float64")})

    def close(self) -> None:
        pass


def rolling_metrics(events: DataFrame, ring: int = RING, last: int = LAST, expected: dict[str, int] | None = None) -> DataFrame:
    """A stream of events(op, seq, duration, success) -> the state of an operation whenever it has new calls.

    ``recent_avg`` is the mean duration of the last successes by ``seq``, of
    ``ring`` kept; with ``expected`` calls, what remains at that pace is told.
    The newest row of an operation is the one with the most calls.  The
    session needs the RocksDB state store.
    """
    own = events.where("op IS NOT NULL AND seq IS NOT NULL").select("op", "seq", F.col("duration").cast("double").alias("duration"), F.coalesce("success", F.lit(False)).alias("success"))
    return own.groupBy("op").transformWithStateInPandas(RollingProcessor(ring, last, expected or {}), STATE, "update", "none")


def newest(states: DataFrame) -> DataFrame:
    """The last state of each operation among those that a stream gave."""
    return states.groupBy("op").agg(F.max_by(F.struct(*[c for c in states.columns if c != "op"]), "calls").alias("s")).select("op", "s.*")
