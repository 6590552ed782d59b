"""Table functions for SQL: rows of a text, and steps of jobs from a table of messages.

``register`` tells them to a session: ``SELECT .. FROM docs, LATERAL
math_spans(text)`` and ``SELECT * FROM job_steps(TABLE(messages))``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..streaming.machine import COUNTED, HOUR, Family
from . import mathx

KINDS = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "int": T.IntegerType()}


def schema_of(fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (x.split() for x in fields.split(", "))])


class MathSpans:
    """The outermost spans of mathematics in a text; none for null."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, (T.StringType, T.NullType)) or text.isTable:
            raise ValueError("math_spans takes a text")
        return AnalyzeResult(schema_of("begin int, end int, match string, math_type string, confidence double, latex string"))

    def eval(self, text: str | None) -> Iterator[tuple]:
        for s in mathx.kept(list(mathx.scan(text))) if text else ():
            yield s.begin, s.end, s.match, mathx.SPANS[s.rule][0], mathx.SPANS[s.rule][2], s.latex


class JobSteps:
    """Steps of jobs from messages(family, job_id, seq, at, action, ..), times in microseconds.

    Spark deals the messages by family and sorts them, so a task holds the
    jobs of one family; ``ttl_hours`` is the time to live of a job that has ended.
    """

    FIELDS = ("job_id", "seq", "at", "action", "status", "progress", "message", "error")

    def __init__(self) -> None:
        self.family: Family | None = None
        self.last: tuple | None = None

    @staticmethod
    def analyze(messages: AnalyzeArgument, ttl_hours: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not messages.isTable or not {"family", *JobSteps.FIELDS} <= set(messages.dataType.fieldNames()):
            raise ValueError(f"job_steps takes TABLE(..) with family, {', '.join(JobSteps.FIELDS)}")
        order = [OrderingColumn(n) for n in ("at", "seq", "job_id", "action")]
        return AnalyzeResult(schema_of(COUNTED), partitionBy=[PartitioningColumn("family")], orderBy=order)

    def eval(self, message: Row, ttl_hours: float = 24.0) -> Iterator[tuple]:
        if self.family is None:
            self.family = Family(ttl=int(float(ttl_hours) * HOUR))
        place = (message["job_id"], message["seq"], message["at"])
        if place != self.last and None not in place:
            yield from self.family.apply(*[message[n] for n in self.FIELDS])
        self.last = place


def register(spark: SparkSession) -> None:
    """math_spans and job_steps become functions of the session's SQL."""
    spark.udtf.register("math_spans", udtf(MathSpans))
    spark.udtf.register("job_steps", udtf(JobSteps))
