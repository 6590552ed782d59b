"""One document of each group of near copies, at an exact similarity of shingle sets.

SimHash fingerprints of 256 bits are compared bit-sliced inside blocks whose
documents share a min-hash band.  Pairs a few bits apart are joined at once;
pairs in doubt are joined only if their shingle sets are as similar as asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise, new_path, scratch
from .components import connected_components
from .simhash import by_cell, cell_arrays, cells, close_pairs, find, fingerprint, fresh, shingle_hashes, spanning_links

SEED = 42
LANES = 4
NAMES = [f"f{i}" for i in range(LANES)]
#: Pairs at most this many of 256 bits apart are joined unchecked: at a similarity just below 0.8 the distance is 39 with
#: a deviation of 6, so such a pair is joined wrongly with a chance of about 0.0001, and one at 0.7 of about 0.00000001.
SURE = 16
#: Pairs further apart are not joined (four deviations beyond the mean at 0.8).
RADIUS = 64
#: A pair at 0.8 misses all bands with a chance of (1 - 0.8 ** 4) ** 24 = 0.000003.
BANDS, BAND_ROWS = 24, 4
#: A chunk of a block has about this many documents and shingles at most.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted different shingle hashes."""
    return np.unique(shingle_hashes(text, shingle, SEED))


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of minima under seeded multipliers."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 2048):
        mixed = hashes[at : at + 2048, None] * odd
        np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0), out=least)
    key = np.zeros(bands, np.uint64)
    for part in least.reshape(bands, rows).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_md5, digest of the shingle set (16 bytes), its size, fingerprint, band keys."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, size, lanes, keys = [], [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py(), shingle)
                digest.append(set_digest(own))
                size.append(len(own))
                lanes.append(fingerprint(own, LANES))
                keys.append(band_keys(own, BANDS, BAND_ROWS))
            columns = np.array(lanes, np.int64).reshape(-1, LANES).T
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), *map(pa.array, columns), bands], ["doc_id", "text_md5", "digest", "size", *NAMES, "bands"])

    schema = f"doc_id long, text_md5 binary, digest binary, size long, {', '.join(f'{n} long' for n in NAMES)}, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5("text")), F.col("text").cast("binary")).mapInArrow(compute, schema)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """docs(doc_id, text) -> digest, hashes (64-bit numbers in a row)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t.as_py(), shingle) for t in batch.column(0).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_digest, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "hashes"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(compute, "digest binary, hashes binary")


def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sure links (a, b) without a cell; rows of pairs in doubt with their cell, ``b`` being what ``a`` is joined to so far."""
    for table in by_cell(batches):
        bits, cell, side = cell_arrays(table, LANES)
        root = spanning_links(bits, cell, SURE, side)
        doubt = 1 + np.arange(len(root))  # zero once a row is in doubt: two such rows need no comparison here
        for i, j in close_pairs(bits, cell, RADIUS, (root, side, doubt)):
            doubt[i] = doubt[j] = 0
        digest = table.column("digest").combine_chunks()
        own, open_ = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(doubt == 0)
        both = np.concatenate([own, open_])
        is_open = np.arange(len(both)) >= len(own)
        rows = [digest.take(pa.array(both)), digest.take(pa.array(root[both])), pa.array(cell[both], mask=~is_open)]
        rest = table.take(pa.array(both)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*rows, *[rest.column(n).combine_chunks() for n in ("side", *NAMES)]], ["a", "b", "cell", "side", *NAMES])


def second_pass(similarity: float):
    """Links between rows in doubt whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            bits, cell, side = cell_arrays(table, LANES)
            digest, joined = table.column("a").combine_chunks(), table.column("b").combine_chunks().dictionary_encode().indices.to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
            _, at, label = np.unique(np.stack([cell, joined]), axis=1, return_index=True, return_inverse=True)
            root = at[label.ravel()]
            links: list[tuple[int, int]] = []
            for i, j in close_pairs(bits, cell, RADIUS, (root, side)):
                for x, y in fresh(i, j, root):
                    a, b = find(root, x), find(root, y)
                    if a == b:
                        continue
                    few, many = sorted((len(sets[x]), len(sets[y])))
                    if few < similarity * many:
                        continue
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if common >= similarity * (few + many - common) - 1e-9:
                        root[max(a, b)] = min(a, b)
                        links.append((x, y))
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([digest.take(pa.array(pairs[:, k])) for k in range(2)], ["a", "b"])

    return run


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs(doc_id, text), each with words and an id -> doc_id, text_md5, keeper(doc_id, text_md5) of its group.

    Groups are the components of pairs whose sets of word shingles have a
    Jaccard similarity of at least ``similarity``.  Equal sets are gathered
    before any comparison.  Rows are known by id and text, so an id that
    stands for several texts is no link between them; the keeper is the
    smallest such pair.  Cells, never pairs, are shuffled: a task finds the
    pairs of its cell and hands on a spanning set of links.
    """
    found = materialise(sketches(docs, shingle), "sketches")
    first = F.min(F.struct("doc_id", "text_md5", "size", *NAMES, "bands")).alias("first")
    distinct = materialise(found.groupBy("digest").agg(F.count("*").alias("n"), first).select("digest", "n", "first.*"), "distinct")
    keys = distinct.select("digest", "size", F.posexplode("bands").alias("t", "key"))
    sums = keys.groupBy("t", "key").agg(F.count("*").alias("n"), F.sum("size").alias("s")).where("n > 1")
    chunks = sums.select("t", "key", F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.least("n", F.col("s") / BLOCK_SHINGLES))).cast("int").alias("chunks"))
    placed = cells(keys.drop("size"), chunks, "digest").join(distinct.select("digest", *NAMES), "digest")
    placed = placed.select("cell", "side", "digest", *NAMES).repartition("cell").sortWithinPartitions("cell")
    lanes_sql = ", ".join(f"{n} long" for n in NAMES)
    passed = materialise(placed.mapInArrow(first_pass, f"a binary, b binary, cell long, side int, {lanes_sql}"), "passed")
    doubts = passed.where("cell IS NOT NULL")
    # other texts of the same ids come along, which no row in doubt asks for
    asked = distinct.join(doubts.select(F.col("a").alias("digest")).distinct(), "digest", "left_semi").select("doc_id")
    sets = materialise(shingle_sets(docs.join(asked, "doc_id", "left_semi"), shingle).dropDuplicates(["digest"]), "sets")
    open_ = doubts.join(sets.withColumnRenamed("digest", "a"), "a").select("cell", "side", "a", "b", *NAMES, "hashes")
    proven = open_.repartition("cell").sortWithinPartitions("cell").mapInArrow(second_pass(similarity), "a binary, b binary")
    parts = connected_components(passed.where("cell IS NULL").select("a", "b").union(proven))
    own = F.struct("doc_id", "text_md5").alias("own")
    linked = materialise(distinct.select("digest", own).join(parts, F.col("digest") == F.col("node")).select("digest", "own", "component"), "linked")
    least = materialise(linked.groupBy("component").agg(F.count("*").alias("n"), F.min("own").alias("least")), "least")
    named = join_hot(linked.select("digest", "component"), least, "component").select(F.col("digest").alias("node"), "least")
    keepers = distinct.select("digest", "n", own).join(named, F.col("digest") == F.col("node"), "left").select("digest", "n", F.coalesce("least", "own").alias("keeper"))
    return join_hot(found.select("doc_id", "text_md5", "digest"), materialise(keepers, "keepers"), "digest").select("doc_id", "text_md5", "keeper")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group stays, with all its columns.

    The row with the smallest doc_id of a group stays, of several the one
    whose text has the smallest MD5, and one of them if that row repeats.  A
    doc_id that stands for several texts loses none of those that are no
    copies.  Rows with a null doc_id and documents without words are no
    one's copies and all stay.  An empty table gives an empty result.
    """
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]") & F.col("doc_id").isNotNull()
    path = new_path(docs.sparkSession, "rows")
    is_keeper = (F.col("doc_id") == F.col("keeper.doc_id")) & (F.col("text_md5") == F.col("keeper.text_md5"))
    with scratch(docs.sparkSession, "groups"):
        found = similar_groups(docs.where(has_words).select("doc_id", "text"), shingle, similarity)
        rows = materialise(found.groupBy("doc_id", "text_md5").agg(F.count("*").alias("n"), F.bool_or(is_keeper).alias("stays")), "rows", path)
    ids = rows.groupBy(F.col("doc_id").alias("own_id")).agg(F.sum("n").alias("n"), F.bool_or("stays").alias("stays"))
    # most ids stand for one row, and their rows go by the id alone
    gone = materialise(ids.where("NOT stays").select("own_id"), "gone")
    repeated = materialise(ids.where("stays AND n > 1").select("own_id"), "repeated")
    worded = docs.where(has_words).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), "text")
    once = worded.join(gone, "own_id", "left_anti").join(repeated, "own_id", "left_anti")
    stays = rows.where("stays").select(F.col("doc_id").alias("own_id"), F.col("text_md5").alias("own_md5")).join(repeated, "own_id", "left_semi")
    again = worded.join(repeated, "own_id", "left_semi").withColumn("own_md5", F.unhex(F.md5("text"))).join(stays, ["own_id", "own_md5"], "left_semi").dropDuplicates(["own_id", "own_md5"])
    return once.select("row.*").unionByName(again.select("row.*")).unionByName(docs.where(~has_words))
