"""Statistics of operations, jobs and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["pending", "processing", "completed", "failed", "cancelled"]


def operation_metrics(events: DataFrame) -> DataFrame:
    """events(op, seq, duration, success) -> calls, totals and extremes of successes, errors, success rate.

    ``avg_time`` divides by the calls made up to the last success; ``seq``
    gives their order.  Only aggregates: an operation's calls meet no sort.
    """
    ok = F.col("success")
    good = F.when(ok, F.col("duration"))
    m = events.groupBy("op").agg(
        F.count("*").alias("calls"), F.round(F.coalesce(F.sum(good), F.lit(0.0)), 6).alias("total_time"), F.min(good).alias("min_time"), F.max(good).alias("max_time"),
        F.count_if(~ok).alias("errors"), F.max(F.when(ok, F.col("seq"))).alias("last_ok"),
    )
    late = events.join(m.select("op", "last_ok"), "op").where("seq > last_ok").groupBy("op").agg(F.count("*").alias("late"))
    m = m.join(late, "op", "left").withColumn("before", F.col("calls") - F.coalesce("late", F.lit(0)))
    return m.select("op", "calls", "total_time", "min_time", "max_time", "errors", F.round((F.col("calls") - F.col("errors")) / F.col("calls"), 6).alias("success_rate"), F.when(F.col("last_ok").isNotNull(), F.round(F.col("total_time") / F.col("before"), 6)).alias("avg_time"))


def recent_average(events: DataFrame, last: int = 10) -> DataFrame:
    """Mean duration of the last successes of each operation."""
    rank = F.row_number().over(Window.partitionBy("op").orderBy(F.desc("seq")))
    return events.where("success").withColumn("rank", rank).where(F.col("rank") <= last).groupBy("op").agg(F.round(F.avg("duration"), 6).alias("recent_avg"))


def slowest(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.orderBy(F.desc("avg_time"), "op").limit(n).select("op", "avg_time")


def summary(metrics: DataFrame, n: int = 10) -> DataFrame:
    """One row over operation metrics: totals, the overall success rate, the slowest and the most frequent operations."""
    total, errors = F.coalesce(F.sum("calls"), F.lit(0)), F.coalesce(F.sum("errors"), F.lit(0))
    top = lambda by, value: F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.coalesce(F.col(value), F.lit(0))).alias("by"), "op", F.col(value)))), 1, n), lambda x: F.struct(x["op"].alias("op"), x[value].alias(value))).alias(by)
    return metrics.agg(
        total.alias("total_operations"), errors.alias("total_errors"), F.round(F.coalesce((total - errors) / F.nullif(total, F.lit(0)), F.lit(1.0)), 6).alias("overall_success_rate"),
        F.count("*").alias("unique_operations"), top("slowest_operations", "avg_time"), top("most_frequent_operations", "calls"),
    )


def resource_summary(samples: DataFrame) -> DataFrame:
    """samples(op, kind, value) -> mean, extremes and number of each operation's samples of a kind (memory, cpu)."""
    return samples.groupBy("op", "kind").agg(F.round(F.avg("value"), 6).alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"), F.count("*").alias("samples"))


# Seconds, success rate, megabytes and percent from which advice is given.
SLOW, UNRELIABLE, MUCH_MEMORY, MUCH_CPU = 5.0, 0.95, 1000.0, 80.0


def recommendations(metrics: DataFrame, resources: DataFrame) -> DataFrame:
    """op, advice, value: what is slow, unreliable or large; one row without an operation if nothing is."""
    of_calls = F.array_compact(F.array(F.when(F.col("avg_time") > SLOW, F.struct(F.lit("slow").alias("advice"), F.col("avg_time").alias("value"))), F.when(F.col("success_rate") < UNRELIABLE, F.struct(F.lit("unreliable").alias("advice"), F.col("success_rate").alias("value")))))
    large = ((F.col("kind") == "memory") & (F.col("max") > MUCH_MEMORY)) | ((F.col("kind") == "cpu") & (F.col("max") > MUCH_CPU))
    found = metrics.select("op", F.inline(of_calls)).unionByName(resources.where(large).select("op", F.concat(F.lit("high "), "kind").alias("advice"), F.col("max").cast("double").alias("value")))
    fine = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("op"), F.lit("fine").alias("advice"), F.lit(None).cast("double").alias("value"))
    return found.unionByName(fine)


def batch_statistics(results: DataFrame) -> DataFrame:
    """results(batch, success, began, ended in seconds) -> success in percent, items a second and seconds an item over the batch's time."""
    wall = (F.max("ended") - F.min("began")).cast("double")
    done = F.count_if("success")
    return results.groupBy("batch").agg(
        F.count("*").alias("items"), done.alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.round(100 * done / F.count("*"), 4).alias("success_percent"),
        F.round(F.coalesce(F.when(wall > 0, done / wall), F.lit(0.0)), 6).alias("throughput"), F.round(F.coalesce(F.when(done > 0, wall / done), F.lit(0.0)), 6).alias("avg_seconds"),
    )


def health(backends: DataFrame) -> DataFrame:
    """backends(service, connected) -> healthy if any of a service's is connected, else degraded."""
    return backends.groupBy("service").agg(F.when(F.bool_or("connected"), "healthy").otherwise("degraded").alias("status"))


def throttled(samples: DataFrame, max_cpu: float = 80.0, max_memory: float = 80.0) -> DataFrame:
    return samples.withColumn("throttled", (F.col("cpu") > max_cpu) | (F.col("memory") > max_memory))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order in which they come first."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def first_few(rows: DataFrame, group: str, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("place") <= n)


def status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs of every status, zero included."""
    every = jobs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, STATUSES))).alias("status"))
    return every.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def job_statistics(jobs: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    seconds = (F.unix_timestamp("completed_at") - F.unix_timestamp("created_at")).cast("double")
    return jobs.agg(
        F.count("*").alias("total"), F.round(100 * F.count_if(done) / F.count("*"), 2).alias("success_percent"),
        F.round(F.avg(F.when(done, seconds)), 2).alias("mean_seconds"), F.count_if(F.col("status").isin("processing", "pending")).alias("active"),
    )


def job_page(jobs: DataFrame, status: str, page: int, size: int) -> DataFrame:
    """One page of a status, newest first, with whether others follow."""
    own = jobs.where(F.col("status") == status)
    total = own.agg(F.count("*")).scalar()
    rows = own.orderBy(F.desc("created_at"), "job_id").offset((page - 1) * size).limit(size).withColumn("total", total)
    return rows.select("job_id", "created_at", "total", (F.col("total") > page * size).alias("has_next"), F.lit(page > 1).alias("has_prev"))


def cache_statistics(entries: DataFrame, max_bytes: int) -> DataFrame:
    used = F.sum("size_bytes")
    return entries.groupBy("cache").agg(F.count("*").alias("entries"), used.alias("bytes"), F.round(used / 1_048_576, 4).alias("megabytes"), F.round(100 * used / max_bytes, 4).alias("percent_used"), F.sum("access_count").alias("accesses"))


def freed_before(entries: DataFrame, key: str, order: str, size: str, bucket: float) -> DataFrame:
    """entries + freed, used: the sizes of a key's entries of smaller ``order`` (ties by entry_id), and of all.

    Running sums within ranges of ``order`` as wide as ``bucket``, on top of
    the sums of the ranges before, so no task sorts all entries of a key.
    """
    placed = entries.withColumn("range", F.floor(F.col(order) / bucket))
    sums = placed.groupBy(key, "range").agg(F.sum(size).alias("total"))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumns({"base": F.coalesce(F.sum("total").over(before), F.lit(0)), "used": F.sum("total").over(Window.partitionBy(key))}).drop("total")
    inner = Window.partitionBy(key, "range").orderBy(order, "entry_id").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("inner", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return own.join(bases, [key, "range"]).withColumn("freed", F.col("base") + F.col("inner")).drop("base", "inner", "range")


def evictions(entries: DataFrame, max_bytes: int, required: int, bucket: float = 3600.0) -> DataFrame:
    """Least recently used entries that go until ``required`` more bytes fit in each cache."""
    return freed_before(entries, "cache", "last_access", "size_bytes", bucket).where(F.col("used") - F.col("freed") + required > max_bytes).select("cache", "entry_id", "size_bytes")


def oldest_to_share(entries: DataFrame, max_bytes: int, share: float = 0.8, bucket: float = 3600.0) -> DataFrame:
    """Oldest entries of a cache beyond its limit that go until no more than ``share`` of the limit is used."""
    gone = (F.col("used") > max_bytes) & (F.col("used") - F.col("freed") > share * max_bytes)
    return freed_before(entries, "cache", "last_access", "size_bytes", bucket).where(gone).select("cache", "entry_id", "size_bytes")


def lookup(requests: DataFrame, memory: DataFrame, store: DataFrame) -> DataFrame:
    """requests(key) -> key, value, tier: memory first, then the store, else a miss."""
    m, s = memory.select("key", F.col("value").alias("m")), store.select("key", F.col("value").alias("s"))
    tier = F.when(F.col("m").isNotNull(), "memory").when(F.col("s").isNotNull(), "store").otherwise("miss")
    return requests.join(m, "key", "left").join(s, "key", "left").select("key", F.coalesce("m", "s").alias("value"), tier.alias("tier"))


def look_through(requests: DataFrame, memory: DataFrame, store: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """Values of requests(key, ..) from memory, store, or ``compute`` for those in neither; and what memory holds from now on.

    ``compute`` turns rows of requests into (key, value); found in the store
    or computed, a value is promoted to memory.
    """
    known = lookup(requests, memory, store)
    missed = requests.join(known.where("tier = 'miss'").select("key"), "key", "left_semi").dropDuplicates(["key"])
    made = compute(missed).select("key", F.col("value").alias("made"))
    values = known.join(made, "key", "left").select("key", F.coalesce("value", "made").alias("value"), F.when(F.col("tier") == "miss", "computed").otherwise(F.col("tier")).alias("tier"))
    fresh = values.where("tier <> 'memory'").select("key", "value").dropDuplicates(["key"])
    return values, memory.select("key", "value").unionByName(fresh)


def named(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """requests(name) -> the catalog's entries of that name, whatever its case; none: nulls."""
    c = catalog.withColumn("lower_name", F.lower("name")).drop("name")
    return requests.withColumn("lower_name", F.lower("name")).join(c, "lower_name", "left").drop("lower_name")


def configured(backends: DataFrame, settings: DataFrame) -> DataFrame:
    """backends(backend) with their settings(backend, enabled, ..); those without are not enabled."""
    return backends.join(settings, "backend", "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)))


def chosen_engine(requests: DataFrame, engines: DataFrame) -> DataFrame:
    """requests(id, engine) -> that engine if it is available, else the first; engines(engine, place)."""
    first = engines.agg(F.min_by("engine", "place")).scalar()
    available = engines.select(F.col("engine").alias("available"))
    return requests.join(available, F.col("engine") == F.col("available"), "left").withColumn("chosen", F.coalesce("available", first)).drop("available")
