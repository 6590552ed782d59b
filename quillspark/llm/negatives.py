"""Hard-negative mining over k-means inverted lists with exact bounds.

Rows are gathered in lists by their nearest centroid.  By Cauchy-Schwarz no row
of a list scores above a'c + |a| r, nor below a'c - |a| r, for an anchor a, the
list's centroid c and its stored radius r.  An anchor visits lists by falling
upper bound, skips those outside its windows of scores, and stops once the
bound is strictly below its k-th score, so the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .simhash import by_cell

SCALE = 256
#: Components must be below this in size, so that scores of up to 2,048 dimensions are longs.
LIMIT = 2.0**18
#: Centroids are fitted on about this many rows (at most twice as many); any fit gives the same results.
SAMPLE_ROWS, MAX_LISTS, ROUNDS = 16_384, 1024, 8
#: Rows are dealt over PARTS parts, or as many as keep a part within PART_ROWS; ASKS anchors meet a part in one task.
PARTS, PART_ROWS, ASKS = 32, 1 << 17, 4096
#: No score is this far from zero.
FAR = 1 << 62
POSITIVES, NEGATIVES = 5, 3

ASK = "row long, vec_id long, label long, x binary, low array<long>, high array<long>, floor array<long>, seed int"
HIT = "row long, w int, score long, vec_id long"


@dataclass
class Lists:
    """The inverted lists: centroids, their radii, and the first part and number of parts of each."""

    centroids: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    splits: np.ndarray

    def bounds(self, x: np.ndarray, lists: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the scores of each row of x with each list, widened by what rounding may take."""
        at = slice(None) if lists is None else lists
        middle = x @ self.centroids[at].T
        reach = np.linalg.norm(x, axis=1)[:, None] * self.radii[at]
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle + reach + slack, middle - reach - slack


def unpacked(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = b"".join([v.as_buffer() for v in values])
    return np.frombuffer(data, np.int32).reshape(len(values), width).astype(np.float64)


def fit_centroids(rows: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from k rows drawn by seed; a centroid without rows stays where it is."""
    draw = np.random.default_rng(13)
    centroids = rows[np.sort(draw.permutation(len(rows))[:k])].copy()
    for _ in range(ROUNDS):
        near = nearest(rows, centroids)[0]
        count = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it, rounded up."""
    near = np.empty(len(rows), np.int64)
    far = np.empty(len(rows))
    half = (centroids * centroids).sum(axis=1) / 2
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        own = (part @ centroids.T - half).argmax(axis=1)
        near[at : at + 4096] = own
        far[at : at + 4096] = np.linalg.norm(part - centroids[own], axis=1)
    return near, far * (1 + 1e-12) + 1e-9


def eligible(rows: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label, x (scaled components as 32-bit integers) of the rows that take part, and the dimension."""
    ok = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LIMIT)) & (F.size("embedding") > 0)
    kept = rows.where(F.coalesce(ok & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    lengths = kept.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    width = lengths["size"] if lengths else 0

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(SCALE * values).astype(np.int32).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "label", "x"])

    own = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    return kept.where(F.size("embedding") == width).select(F.col("vec_id").cast("long"), label, "embedding").mapInArrow(scale, "vec_id long, label long, x binary"), width


def build(rows: DataFrame, width: int) -> tuple[DataFrame, Lists]:
    """rows(vec_id, label, x) -> the index (row, vec_id, label, x, list, part) and its lists.

    Every row is indexed.  A list of more than a part's rows is dealt over
    several parts; small lists share one.  The driver gets the sample and one
    row for each list.
    """
    spark = rows.sparkSession
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 30)))
    sample = [r.x for r in rows.where(draw).select("x").limit(2 * SAMPLE_ROWS).collect()] or [r.x for r in rows.select("x").limit(1).collect()]
    drawn = np.frombuffer(b"".join(sample), np.int32).reshape(len(sample), width).astype(np.float64)
    centroids = fit_centroids(drawn, min(MAX_LISTS, int(np.ceil(np.sqrt(n)))))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = nearest(unpacked(batch.column("x"), width), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], ["row", "vec_id", "label", "x", "list", "far"])

    placed = rows.select("row", "vec_id", "label", "x").mapInArrow(assign, "row long, vec_id long, label long, x binary, list int, far double")
    placed = materialise(placed, "placed")
    sizes = {r["list"]: (r.n, r.far) for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    used = sorted(sizes)
    part_rows = max(256, min(PART_ROWS, -(-n // PARTS)))
    first, splits, part, filled = [], [], 0, 0
    for k in used:
        count = sizes[k][0]
        if filled and filled + count > part_rows:
            part, filled = part + 1, 0
        first.append(part)
        splits.append(-(-count // part_rows))
        filled += count
        if splits[-1] > 1:
            part, filled = part + splits[-1], 0
    lists = Lists(centroids[used], np.array([sizes[k][1] for k in used]), np.array(first), np.array(splits))
    table = spark.createDataFrame([(int(k), i, f, s) for i, (k, f, s) in enumerate(zip(used, first, splits, strict=True))], "list int, own int, first int, splits int")
    deal = F.col("first") + F.pmod(F.xxhash64("row"), F.col("splits")).cast("int")
    index = placed.join(F.broadcast(table), "list").select("row", "vec_id", "label", "x", F.col("own").alias("list"), deal.alias("part"))
    return materialise(index, "index"), lists


def route(asks: DataFrame, lists: Lists, width: int, seeds: bool) -> DataFrame:
    """asks -> part and the ask, for each part with a list that may hold what a window asks for.

    First (``seeds``) an ask goes to the part of the list with the highest bound
    alone, which then is its ``seed``; afterwards, with the scores found there as floors, to the others.
    """
    shared = asks.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        list_of = np.repeat(np.arange(len(own.first)), own.splits)
        part_of = np.concatenate([f + np.arange(s) for f, s in zip(own.first, own.splits, strict=True)])
        starts = np.flatnonzero(np.r_[True, part_of[1:] != part_of[:-1]])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                upper, lower = own.bounds(unpacked(batch.column("x"), width))
                open_ = np.zeros(upper.shape, bool)
                for k, (low, high, floor) in enumerate(zip(*[batch.column(n).to_pylist() for n in ("low", "high", "floor")], strict=True)):
                    for a, b, c in zip(low, high, floor, strict=True):
                        open_[k] |= (upper[k] >= max(a, c)) & (lower[k] <= b)
                if seeds:
                    asked = np.flatnonzero(open_.any(axis=1))
                    best = np.where(open_, upper, -np.inf).argmax(axis=1)[asked]
                    parts = own.first[best]
                else:
                    wanted = np.logical_or.reduceat(open_[:, list_of], starts, axis=1)
                    asked, place = np.nonzero(wanted)
                    parts = part_of[starts][place]
                    other = parts != batch.column("seed").to_numpy(zero_copy_only=False)[asked]
                    asked, parts = asked[other], parts[other]
                rows = batch.take(pa.array(asked))
                part = pa.array(parts.astype(np.int32))
                columns = [part if n == "seed" and seeds else rows.column(n) for n in rows.schema.names]
                yield pa.RecordBatch.from_arrays([part, *columns], ["part", *rows.schema.names])

    return asks.mapInArrow(run, f"part int, {ASK}")


class Best:
    """The best k hits of one window: highest scores, then smallest ids."""

    def __init__(self, low: int, high: int, floor: int, k: int) -> None:
        self.need, self.high, self.k = max(low, floor), high, k
        self.score, self.vec_id = np.empty(0, np.int64), np.empty(0, np.int64)

    def take(self, score: np.ndarray, vec_id: np.ndarray) -> None:
        fits = (score >= self.need) & (score <= self.high)
        if not fits.any():
            return
        score, vec_id = np.r_[self.score, score[fits]], np.r_[self.vec_id, vec_id[fits]]
        order = np.lexsort((vec_id, -score))[: self.k]
        self.score, self.vec_id = score[order], vec_id[order]
        if len(order) == self.k:
            self.need = max(self.need, int(self.score[-1]))


def visit(lists: Lists, width: int, same: bool, k: int):
    """Cells of one part's rows and some asks -> the best k hits of each window."""

    def search(cell: pa.Table) -> Iterator[tuple[int, int, int, int]]:
        side = cell.column("side").to_numpy()
        count = int((side == 0).sum())
        rows, asks = cell.slice(0, count), cell.slice(count)
        if not count or not len(asks):
            return
        x, a = unpacked(rows.column("x"), width), unpacked(asks.column("x"), width)
        upper, lower = np.abs(x).max(), np.abs(a).max()
        if upper * lower * width >= 2**53:  # beyond what doubles add up exactly
            scores_of = (x.astype(np.int64), a.astype(np.int64))
        else:
            scores_of = (x, a)
        label, vec_id, row = [rows.column(n).to_numpy() for n in ("label", "vec_id", "row")]
        own = rows.column("list").to_numpy()
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ends = np.r_[cuts[1:], count]
        upper, lower = lists.bounds(a, own[cuts])
        orders = np.argsort(-upper, axis=1, kind="stable")
        names = ("row", "label", "low", "high", "floor")
        for at, (ask_row, ask_label, low, high, floor) in enumerate(zip(*[asks.column(n).to_pylist() for n in names], strict=True)):
            best = [Best(*w, k) for w in zip(low, high, floor, strict=True)]
            for place in orders[at]:
                reached = [b for b in best if upper[at, place] >= b.need]
                if not reached:
                    break  # bounds only fall from here on, strictly below every k-th score
                if not any(lower[at, place] <= b.high for b in reached):
                    continue
                begin, end = cuts[place], ends[place]
                score = (scores_of[0][begin:end] @ scores_of[1][at]).astype(np.int64)
                fits = (score >= min(b.need for b in reached)) & (score <= max(b.high for b in reached)) & ((label[begin:end] == ask_label) == same)
                if same:
                    fits &= row[begin:end] != ask_row
                hits = np.flatnonzero(fits)
                if len(hits):
                    for b in reached:
                        b.take(score[hits], vec_id[begin:end][hits])
            for w, b in enumerate(best):
                yield from ((ask_row, w, s, v) for s, v in zip(b.score.tolist(), b.vec_id.tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            cell = table.column("cell").to_numpy()
            cuts = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found = np.array(list(search(table.slice(begin, end - begin))), np.int64).reshape(-1, 4)
                columns = [pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2]), pa.array(found[:, 3])]
                yield pa.RecordBatch.from_arrays(columns, ["row", "w", "score", "vec_id"])

    return run


def probe(index: DataFrame, routed: DataFrame, lists: Lists, width: int, same: bool, k: int) -> DataFrame:
    """Best hits of each routed ask in its part: row, w, score, vec_id.

    A cell is a part and at most about ASKS of the asks that want it, so a part
    goes to as many tasks as its asks need, and no task gets more than one part at a time.
    """
    chunks = routed.groupBy("part").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("chunks"))
    cell = lambda chunk: (F.shiftleft(F.col("part").cast("long"), 32) + chunk).alias("cell")
    plain = ["row", "vec_id", "label", "x"]
    none = [F.lit(None).cast("array<long>").alias(n) for n in ("low", "high", "floor")]
    rows = index.join(F.broadcast(chunks), "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(cell(F.col("chunk")), F.lit(0).alias("side"), "list", *plain, *none)
    asks = routed.join(F.broadcast(chunks), "part").select(cell(F.pmod(F.xxhash64("row"), F.col("chunks"))), F.lit(1).alias("side"), F.lit(0).alias("list"), *plain, "low", "high", "floor")
    both = rows.unionByName(asks).repartition("cell").sortWithinPartitions("cell", "side", "list")
    return both.mapInArrow(visit(lists, width, same, k), HIT)


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "w").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, asks: DataFrame, lists: Lists, width: int, same: bool, k: int) -> DataFrame:
    """asks(row, vec_id, label, x, low, high) -> row, w, score, vec_id, rank: the best k rows of each window.

    ``same`` looks among the other rows of the ask's label, else among rows of
    other labels.  The part with the most promising list is searched first;
    its k-th scores are the floors of the search in the rest.
    """
    least = lambda like: F.transform(like, lambda _: F.lit(-FAR).cast("long"))
    asks = asks.select("row", "vec_id", "label", "x", "low", "high", least(F.col("low")).alias("floor"), F.lit(-1).alias("seed"))
    seeded = materialise(route(asks, lists, width, True), "seeds")
    found = materialise(probe(index, seeded, lists, width, same, k), "hits")
    full = found.groupBy("row", "w").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
    floors = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("floors"))
    floor: Column = F.transform("low", lambda _, i: F.coalesce(F.element_at("floors", i), F.lit(-FAR)))
    again = seeded.drop("part").join(floors, "row", "left").withColumn("floor", F.when(F.col("floors").isNull(), F.col("floor")).otherwise(floor))
    rest = materialise(route(again.select(*asks.columns), lists, width, False), "asks")
    return best(found.unionByName(probe(index, rest, lists, width, same, k)), k)


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95, every: int = 50) -> DataFrame:
    """rows(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id ``every`` divides.  Their positives are
    the best rows of the same label, and the negatives of a positive the best
    rows of other labels that score from ``low`` to ``high`` per cent of it.

    Rows with a null label, id or vector, with a null or non-finite component
    or one of 2^18 or more in size, or not of the most frequent length, take
    no part.  Rows that share a vec_id are rows of their own.  A positive with a negative
    score has no negatives.  An empty table gives an empty result; other columns are not read.
    """
    found, width = eligible(rows)
    nothing = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not width:
        return nothing
    index, lists = build(found, width)
    anchors = index.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "x")
    whole = lambda v: F.array(F.lit(v).cast("long"))
    near = materialise(search(index, anchors.withColumns({"low": whole(-FAR), "high": whole(FAR)}), lists, width, True, positives), "positives")
    usable = near.where("score >= 0").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("found"))
    usable = materialise(usable, "usable")
    share = lambda by, f: F.transform("found", lambda p: f(p["score"].cast("decimal(20,0)") * by / 100).cast("long"))
    asks = anchors.join(usable, "row").withColumns({"low": share(low, F.ceil), "high": share(high, F.floor)})
    hits = search(index, asks.drop("found"), lists, width, False, negatives)
    pairs = anchors.select("row", F.col("vec_id").alias("anchor_id")).join(usable, "row").select("row", "anchor_id", F.posexplode("found").alias("w", "positive"))
    joined = hits.join(pairs, ["row", "w"])
    return joined.select("anchor_id", F.col("positive.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(rows: DataFrame) -> DataFrame:
    """The contract's result."""
    return hard_negatives(rows)
