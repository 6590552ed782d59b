"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes sets chunk ends, so an insertion
moves only the ends near it, and equal passages fall into equal chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialise

#: One pseudo-random 32-bit number for each byte value.
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes, spacing: int = 32, least: int = 16, most: int = 512) -> np.ndarray:
    """Ends of the chunks of ``data``; the last is its length.

    The hash after byte i is the sum of gear[byte i-k] << k over k < 32, built
    in five doublings.  An end follows where it falls in the lowest
    1/``spacing`` of its range, at least ``least`` bytes after the last end;
    chunks of ``most`` bytes end anyway.
    """
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        shifted = h.copy()
        shifted[k:] += h[:-k] << np.uint32(k)
        h = shifted
    ends, last, size = [], 0, len(data)
    for at in (np.flatnonzero(h < np.uint32((1 << 32) // spacing)) + 1).tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while size - last > most:
        last += most
        ends.append(last)
    if last < size:
        ends.append(size)
    return np.array(ends, np.int64)


def repeated_spans(docs: DataFrame, min_chars: int = 100, spacing: int = 32, least: int = 16, most: int = 512) -> DataFrame:
    """docs(doc_id, text) -> doc_id, begin, end, first_doc, kept: repeated passages.

    A span is a run of neighbouring chunks whose digests occur elsewhere too,
    of at least ``min_chars`` characters (code points, end exclusive).
    ``first_doc`` is the smallest doc_id that holds the chunks (the smallest
    of them over the span); ``kept`` spans are those of the first document,
    the others are the copies to remove.  Chunk ends are found a few dozen
    characters after a passage begins, so a span is a little shorter than
    its passage.

    Null and empty texts have no chunks; rows with a null doc_id are never
    the first; repeated rows repeat all their chunks.  Digests are 128 bits
    wide.  Other columns are not read.
    """
    return spans_of_rows(docs, min_chars, spacing, least, most).drop("text_md5")


def spans_of_rows(docs: DataFrame, min_chars: int = 100, spacing: int = 32, least: int = 16, most: int = 512) -> DataFrame:
    """repeated_spans with the MD5 of the text that each span lies in, which tells rows of one doc_id apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, points = [], []
            for text in batch.column(2):
                data = text.as_py() or b""
                ends = chunk_ends(data, spacing, least, most)
                begins = np.r_[np.int64(0), ends][:-1]
                digest = xxhash.xxh3_128_digest
                digests.append(np.frombuffer(b"".join([digest(data[b:e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2))
                # code points begun before each end
                count = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                points.append(count[ends - 1].astype(np.int32) if len(ends) else ends.astype(np.int32))
            halves = [pa.array([d[:, k] for d in digests], pa.list_(pa.int64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *halves, pa.array(points, pa.list_(pa.int32()))], ["doc_id", "text_md5", "high", "low", "ends"])

    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5("text")).alias("text_md5"), F.col("text").cast("binary"))
    cuts = rows.mapInArrow(cut, "doc_id long, text_md5 binary, high array<long>, low array<long>, ends array<int>")
    cuts = materialise(cuts.withColumn("row", F.monotonically_increasing_id()), "chunks")
    seen = cuts.select("doc_id", F.explode(F.arrays_zip("high", "low")).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    repeated = materialise(seen.where("n > 1 AND first_doc IS NOT NULL"), "repeated")
    chunks = cuts.select("doc_id", "text_md5", "row", "ends", F.posexplode(F.arrays_zip("high", "low")).alias("k", "chunk"))
    chunks = chunks.select("doc_id", "text_md5", "row", "k", "chunk", F.when(F.col("k") > 0, F.col("ends")[F.col("k") - 1]).otherwise(0).alias("begin"), F.col("ends")[F.col("k")].alias("end"))
    found = join_hot(chunks, repeated, "chunk").where("first_doc IS NOT NULL").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("first_doc"), F.lit(False)))
    run = F.col("k") - F.row_number().over(Window.partitionBy("row", "kept").orderBy("k"))
    spans = found.withColumn("run", run).groupBy("row", "doc_id", "text_md5", "kept", "run").agg(F.min("begin").cast("long").alias("begin"), F.max("end").cast("long").alias("end"), F.min("first_doc").alias("first_doc"))
    return spans.where(F.col("end") - F.col("begin") >= min_chars).select("doc_id", "begin", "end", "first_doc", "kept", "text_md5")


def remove_repeats(docs: DataFrame, min_chars: int = 100) -> DataFrame:
    """docs with the repeated passages cut out of all but the first document; every row and column stays.

    Rows are known by doc_id and text, so texts that share an id are cut each
    by its own spans; rows with a null doc_id, never the first, are cut as
    copies.  Null and empty texts stay as they are, repeated rows alike; an
    empty table gives an empty result.
    """
    spans = spans_of_rows(docs, min_chars).where("NOT kept").select("doc_id", "text_md5", "begin", "end").distinct()
    lists = spans.groupBy("doc_id", "text_md5").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("cuts"))
    lists = lists.select(F.col("doc_id").alias("cut_id"), F.col("text_md5").alias("cut_md5"), "cuts")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), "text", F.unhex(F.md5("text")).alias("own_md5"))
    joined = rows.join(lists, F.col("own_id").eqNullSafe(F.col("cut_id")) & (F.col("own_md5") == F.col("cut_md5")), "left")
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    step = lambda s, x: F.struct(F.concat(s["text"], F.substring("text", (s["at"] + 1).cast("int"), (x["begin"] - s["at"]).cast("int"))).alias("text"), x["end"].alias("at"))
    done = F.aggregate("cuts", start, step, lambda s: F.concat(s["text"], F.substring("text", (s["at"] + 1).cast("int"), F.length("text"))))
    return joined.select(*[F.when(F.col("cuts").isNull(), F.col("text")).otherwise(done).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op4_substring_dedup(docs: DataFrame) -> DataFrame:
    """All repeated passages of the documents: one row for each span."""
    return repeated_spans(docs)
