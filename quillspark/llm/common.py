"""Shared-folder tables and small helpers used by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the six ASCII white-space characters.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (tests) takes a temporary
    folder of this machine and remembers it; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch.get() or shared_dir(spark) + '/quillspark'}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables that are written inside go when the block ends; write its result elsewhere before."""
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        delete(spark, path)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner
    the true size of the table, so that joins broadcast only what is small.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value, body):
    """body(value) with ``value`` evaluated once, however often the body uses it.

    A one-element transform binds it: plain columns would be inlined into
    lambdas by the optimiser and evaluated there for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(numbers):
    """Running sums of an array column (each with its own element), by blocks of about the root of its size."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)

    def by_blocks(a):
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))

        def sums(w):
            count = F.floor((F.size(a) + w - 1) / w).cast("int")
            blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda j: total(F.slice(a, j * w + 1, w)))
            starts = let(blocks, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda j: total(F.slice(b, F.lit(1), j))))
            return let(starts, lambda p: F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda k: F.get(p, F.floor(k / w).cast("int")) + total(F.slice(a, F.floor(k / w).cast("int") * w + 1, k % w + 1))))

        return let(width, sums)

    return F.when(F.size(numbers) == 0, F.array().cast("array<bigint>")).otherwise(let(numbers, by_blocks))


def join_hot(rows: DataFrame, found: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """rows left join found(key, n, ..) on ``key``; ``n`` of found tells how many rows have the key.

    Keys that more than ``share`` of all rows have are at most 1 / share, so
    what belongs to them is broadcast and their rows are not shuffled at all.
    Null keys match each other.
    """
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot, rest = found.where(F.col("n") > share * total).drop("n"), found.where(F.col("n") <= share * total).drop("n")
    theirs = F.col("found_key")

    def joined(part: DataFrame, other: DataFrame, how: str) -> DataFrame:
        return part.join(other.withColumnRenamed(key, "found_key"), F.col(key).eqNullSafe(theirs), how)

    common = joined(rows, F.broadcast(hot), "inner").drop("found_key")
    rare = joined(rows, F.broadcast(hot.select(key)), "left_anti")
    return common.unionByName(joined(rare, rest, "left").drop("found_key"))
