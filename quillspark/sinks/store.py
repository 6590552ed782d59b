"""The result store in buckets: lookups read the buckets of their keys, joins and the newest values move no stored row.

A store is a folder of Parquet files, dealt by the hash of the key, with the
number of its buckets beside them; each session that opens it tells its catalog.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "key STRING, value STRING, stored_at TIMESTAMP, size_bytes BIGINT"


@dataclass
class Store:
    """An open store; see ``create`` and ``open_store``."""

    spark: SparkSession
    path: str
    buckets: int

    @property
    def table(self) -> str:
        return "store_" + hashlib.md5(self.path.encode()).hexdigest()

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def put(self, results: DataFrame) -> None:
        """Append results(key, value, stored_at); a task writes one bucket, and rows without a key are left out."""
        rows = results.where("key IS NOT NULL").select("key", "value", "stored_at", F.octet_length("value").cast("long").alias("size_bytes"))
        dealt = rows.repartition(self.buckets, "key")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", self.path + "/data").saveAsTable(self.table)

    def newest(self, rows: DataFrame | None = None) -> DataFrame:
        """The newest value of each key, without an exchange of the store."""
        last = F.max_by(F.struct("value", "size_bytes"), F.struct("stored_at", "value"))
        found = (self.rows() if rows is None else rows).groupBy("key").agg(last.alias("v"), F.max("stored_at").alias("stored_at"))
        return found.select("key", "v.value", "v.size_bytes", "stored_at")

    def get(self, *keys: str) -> DataFrame:
        """The newest values of a few keys; only their buckets are read."""
        return self.newest(self.rows().where(F.col("key").isin(*keys)))

    def look_up(self, requests: DataFrame) -> DataFrame:
        """requests(key, ..) -> the same with value and stored_at, null where the store has none.

        The requests go to the buckets, not the store to the requests.
        """
        found = self.newest().select("key", "value", "stored_at").hint("merge")
        return requests.repartition(self.buckets, "key").join(found, "key", "left")

    def compact(self, into: str) -> Store:
        """A store of the newest values alone, with one file for each bucket."""
        out = create(self.spark, into, self.buckets)
        out.put(self.newest())
        return out


def meta(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_store.json")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def create(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """A new, empty store at a path."""
    files, target = meta(spark, path)
    out = files.create(target, False)
    out.write(json.dumps({"buckets": buckets}).encode())
    out.close()
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> Store:
    """The store at a path, told to this session's catalog."""
    files, target = meta(spark, path)
    told = files.open(target)
    text = bytes(told.readAllBytes()).decode()
    told.close()
    store = Store(spark, path, json.loads(text)["buckets"])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {store.table} ({FIELDS}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {store.buckets} BUCKETS LOCATION '{path}/data'")
    return store
