"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: The dynamic programme starts when this many words are left to place.
DP_WORDS = 8192
#: Rows of one (source, length) group that are ranked together.
RANK_ROWS = 1000


def source_targets(sources: DataFrame, weights: tuple[float, ...], budget: float, max_repeats: int) -> DataFrame:
    """sources(source, source_size) -> + target.

    Sources in code-point order, null last, take the weights in turn.  A
    target stops at ``max_repeats`` times its source; the excess goes to the
    others by weight.  That fixed point is found in closed form: ordered by
    cap over weight, the first source whose share stays under its cap sets
    the share of a unit of weight for all that follow.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1)).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.withColumn("place", F.row_number().over(order)).withColumn("total", F.lit(float(budget)) * F.sum("source_size").over(everything))
    filled = filled.withColumn("unit", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.col("cap") > F.col("unit") * F.col("weight")
    filled = filled.withColumn("share", F.min_by(F.when(free, F.col("unit")), F.when(free, F.col("place"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("share") * F.col("weight"), F.col("cap")))
    return filled.select("source", "source_size", target.alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that words sum to ``budget``.

    The even share of each length comes first, rounded down; single documents
    follow, largest dropped fraction first; a bounded-knapsack programme over
    reachable sums (a bit set) places the last words exactly, or as near below
    as any subset gets.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    share = counts * (budget / total)
    take = np.minimum(np.floor(share).astype(np.int64), counts)
    left = budget - int((take * lengths).sum())
    for k in np.argsort(take - share, kind="stable"):
        if left <= DP_WORDS:
            break
        if 0 < lengths[k] <= left and take[k] < counts[k]:
            take[k] += 1
            left -= int(lengths[k])
    reach, steps = 1, []  # bit s is set if the sum s can be had
    full = (1 << (left + 1)) - 1
    for k in np.argsort(lengths, kind="stable"):
        length, spare, piece = int(lengths[k]), int(counts[k] - take[k]), 1
        if not 0 < length <= left:
            continue
        spare = min(spare, left // length)
        while spare and not reach >> left & 1:  # binary splitting of the bound
            piece = min(piece, spare)
            steps.append((k, piece, reach))
            reach |= (reach << (piece * length)) & full
            spare -= piece
            piece *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for k, piece, before in reversed(steps):
        if not before >> at & 1:
            take[k] += piece
            at -= piece * int(lengths[k])
    return take


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, max_repeats: int = 2, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, times, taken.

    ``times`` is how often the mix takes the document (0 to ``max_repeats``),
    ``taken`` its words.  Whole passes over a source come first; the rest of
    its target is fitted over the counts of its exact lengths, and documents
    of a length are chosen by a seeded hash of doc_id, so reruns agree.

    A null text has size 0; a null source is a source of its own, last;
    repeated rows are separate documents; an empty table gives an empty
    result; a source without words has target 0.  Groups of one source and
    length are ranked in hashed buckets of about RANK_ROWS rows, so a length
    that holds a third of all rows is spread over tasks.  The histogram of a
    source has as many rows as it has different lengths.
    """
    sizes = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    histogram = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    histogram = materialise(histogram, "histogram")
    sources = source_targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, budget, max_repeats)
    sources = materialise(sources, "targets")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ignore_index=True)
        whole, target = int(group.source_size[0]), float(group.target[0])
        passes = min(int(target / whole), max_repeats) if whole else 0
        rest = round(target - passes * whole) if passes < max_repeats else 0
        group["extra"] = fit_counts(group["size"].to_numpy(np.int64), group.n.to_numpy(np.int64), rest)
        group["passes"] = passes
        return group[["source", "size", "n", "source_size", "target", "passes", "extra"]]

    same = histogram["source"].eqNullSafe(sources["source"])
    plan = histogram.join(sources, same).select(histogram["source"], "size", "n", "source_size", "target")
    plan = plan.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, passes long, extra long")
    plan = materialise(plan.withColumn("buckets", F.ceil(F.col("n") / RANK_ROWS)), "plan")

    p = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target", "passes", "extra", "buckets")
    rows = sizes.join(p, sizes["source"].eqNullSafe(p["p_source"]) & (sizes["size"] == p["p_size"])).drop("p_source", "p_size")
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("draw", "buckets"))
    filled = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"), F.max("extra").alias("extra"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = filled.select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("bucket").alias("q_bucket"), F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - before)).alias("quota"))
    rows = rows.join(quota, rows["source"].eqNullSafe(quota["q_source"]) & (rows["size"] == quota["q_size"]) & (rows["bucket"] == quota["q_bucket"]))
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", "doc_id"))
    rows = rows.withColumn("times", F.col("passes") + F.when(place <= F.col("quota"), 1).otherwise(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.col("times").cast("long"), (F.col("times") * F.col("size")).alias("taken"))


def op1_mix(docs: DataFrame) -> DataFrame:
    """The contract's result: doc_id, size, source_size, target, taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.0, max_repeats: int = 2, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows that agree in doc_id, source and size share their group's numbers,
    dealt in the order of a hash of the text.  A null text has no words, and
    is taken as often as others of its size; a null source is a source, null
    doc_ids agree; an empty table gives an empty result; extra columns come along.
    """
    columns = docs.columns
    plan = mix(docs, weights, budget, max_repeats, seed).where("times > 0")
    plan = plan.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("times"))))
    plan = plan.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), F.col("k").alias("m_k"), "times")
    sized = docs.select(F.struct(*columns).alias("row"), "doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    sized = sized.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("h")))
    joined = sized.join(plan, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("size") == F.col("m_size")) & (F.col("k") == F.col("m_k")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")
