"""Exact deduplication by composable polynomial fingerprints.

A fingerprint is the value of a text's bytes as a polynomial, modulo a prime,
at four fixed points.  That of A + B is that of A times the point to the power
of B's length, plus that of B, so pieces of a huge text are hashed in separate
tasks and added up.  Equal fingerprints only nominate: the texts behind them
are then compared, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_hot, materialise

PRIME = (1 << 31) - 1
#: The points, one for each lane.
POINTS = np.random.default_rng(12).integers(1 << 20, PRIME, 4)
LANES = [f"h{k}" for k in range(len(POINTS))]
#: Longer texts are hashed and compared in pieces of this many bytes.
PIECE = 1 << 16
#: Members of a group, and bytes of theirs, that one task compares with the group's first.
SALT_ROWS, SALT_BYTES = 256, 64 << 20
#: Repeated fingerprints are broadcast up to this many (about 100 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 250_000

TEXT = ["n_bytes", "high", "low"]


def falling_powers(size: int, prime: int = PRIME) -> np.ndarray:
    """Powers size-1 .. 0 of each point, a row for each."""
    powers = np.ones((len(POINTS), 1), np.int64)
    while powers.shape[1] < size:
        step = np.array([pow(int(x), powers.shape[1], prime) for x in POINTS], np.int64)
        powers = np.concatenate([powers, powers * step[:, None] % prime], axis=1)
    return np.ascontiguousarray(powers[:, :size][:, ::-1])


def piece_lanes(data: bytes, powers: np.ndarray, prime: int = PRIME) -> list[int]:
    """Fingerprint lanes of at most 2^24 bytes; ``powers`` are falling_powers of that length or more."""
    points = np.frombuffer(data, np.uint8).astype(np.int64)
    return [int(points @ row[row.size - points.size :]) % prime for row in powers]


def shifted(lanes: list[int], after: int, prime: int = PRIME) -> list[int]:
    """What a piece adds to the fingerprint of a text that has ``after`` bytes behind it."""
    return [h * pow(int(x), after, prime) % prime for h, x in zip(lanes, POINTS, strict=True)] if after else lanes


def add_lanes(frame: DataFrame, piece: int, keep_text: bool, prime: int) -> DataFrame:
    """frame(.., text binary, after) -> its columns but ``after`` (and text, if not kept), and the lanes."""
    names = [c for c in frame.columns if c != "after" and (keep_text or c != "text")]
    kinds = dict(frame.dtypes)
    powers = falling_powers(piece, prime)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after = batch.column("after").to_pylist()
            found = [shifted(piece_lanes(t.as_buffer(), powers, prime), n, prime) for t, n in zip(batch.column("text"), after, strict=True)]
            lanes = np.array(found, np.int64).reshape(-1, len(LANES)).T
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *map(pa.array, lanes)], [*names, *LANES])

    return frame.mapInArrow(run, ", ".join([*[f"`{n}` {kinds[n]}" for n in names], *[f"{n} long" for n in LANES]]))


def normalised(part: DataFrame) -> DataFrame:
    """doc_id, text_sha256, n_bytes, text as bytes: a run of white space counts as one space, a null text as empty."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ").cast("binary")
    return part.select(F.col("doc_id").cast("long"), F.sha2(plain, 256).alias("text_sha256"), F.octet_length(plain).cast("long").alias("n_bytes"), plain.alias("text"))


def huge_texts(docs: DataFrame, piece: int = PIECE, prime: int = PRIME) -> DataFrame:
    """Normalised texts of more than ``piece`` bytes with their lanes.

    They are written to the shared folder, dealt over tasks in pieces, and
    what each piece adds to its text's lanes is summed.
    """
    huge = materialise(normalised(docs.where(F.octet_length("text") > piece)).withColumn("row", F.monotonically_increasing_id()), "huge")
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.lit(0), F.col("n_bytes") - 1) / piece))).alias("place")
    begin = F.col("place") * piece
    pieces = huge.select("row", "n_bytes", "text", place)
    pieces = pieces.select("row", "place", F.substring("text", (begin + 1).cast("int"), piece).alias("text"), F.greatest(F.lit(0).cast("long"), F.col("n_bytes") - begin - piece).alias("after"))
    sums = add_lanes(pieces.repartition("row", "place"), piece, False, prime).groupBy("row").agg(*[(F.sum(n) % prime).alias(n) for n in LANES])
    return materialise(huge.join(sums, "row").drop("row"), "large")


def fingerprints(docs: DataFrame, large: DataFrame, keep_text: bool = False, piece: int = PIECE, prime: int = PRIME) -> DataFrame:
    """docs(doc_id, text), huge_texts of docs -> doc_id, text_sha256, print(n_bytes, high, low), and the normalised text as bytes if asked for."""
    small = normalised(docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= piece)).withColumn("after", F.lit(0))
    small = add_lanes(small, piece, keep_text, prime)
    packed = [(F.shiftleft(a, 31) + F.col(b)).alias(n) for n, (a, b) in zip(TEXT[1:], (LANES[:2], LANES[2:]), strict=True)]
    return small.unionByName(large.select(*small.columns)).select("doc_id", "text_sha256", F.struct("n_bytes", *packed).alias("print"), *["text"] * keep_text)


def matched(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows inner join found(print, n); broadcast where ``found`` is small, and its frequent prints anyway."""
    if found.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), "print")
    return join_hot(rows, found.withColumn("copies", F.col("n")), "print").where("copies IS NOT NULL").withColumnRenamed("copies", "n")


def before() -> Column:
    """Order of the rows of a group: by doc_id, nulls last, then by place in the table."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")


def unequal(copies: DataFrame, piece: int = PIECE) -> DataFrame:
    """copies(row, doc_id, print, n, text) -> row of each text that differs from the first of its print.

    Each place of a text is compared on its own, as a stream: rows come sorted
    by print, salt and place, the first row leading, and a task holds the
    leading piece alone.  Large groups are dealt over salts, each with a copy of
    the first text.
    """
    salts = F.ceil(F.greatest(F.col("n") / SALT_ROWS, F.least("n", F.col("n") * F.col("print.n_bytes") / SALT_BYTES))).cast("int")
    rows = copies.withColumn("salts", F.greatest(F.lit(1), salts))
    many = rows.where("salts > 1")
    first = many.groupBy("print").agg(F.min(before()).alias("first")).select(F.col("first.row").alias("row"))
    leaders = many.join(first, "row", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).withColumn("lead", F.lit(1)).unionByName(leaders.withColumn("lead", F.lit(0)))
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.lit(0).cast("long"), F.col("print.n_bytes") - 1) / piece)))
    pieces = dealt.select("print", "salt", "lead", "doc_id", "row", "text", place.alias("place"))
    pieces = pieces.select("print.*", "salt", "place", "lead", before().alias("at"), "row", F.substring("text", (F.col("place") * piece + 1).cast("int"), piece).alias("piece"))
    key = [*TEXT, "salt", "place"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, leading = None, b""
        for batch in batches:
            keys = zip(*[batch.column(n).to_pylist() for n in key], strict=True)
            odd = []
            for k, (its, piece) in enumerate(zip(keys, batch.column("piece"), strict=True)):
                if its != own:
                    own, leading = its, piece.as_py()
                elif piece.as_py() != leading:
                    odd.append(k)
            if odd:
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(odd))], ["row"])

    ordered = pieces.repartition(*key).sortWithinPartitions(*key, "lead", "at").select(*key, "row", "piece")
    return ordered.mapInArrow(compare, "row long").distinct()


def exact_copies(docs: DataFrame, piece: int = PIECE, prime: int = PRIME) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Texts are equal when they are identical once each run of white space is
    one space; null counts as empty.  The row with the smallest doc_id stays,
    nulls last, and of rows that share it one stays; ``keep_id`` is null only
    where no copy has a doc_id.  Texts whose fingerprints agree by chance are
    told apart by their bytes.  An empty table gives an empty result; other
    columns are not read.
    """
    large = huge_texts(docs, piece, prime)
    prints = fingerprints(docs, large, False, piece, prime)
    groups = materialise(prints.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("text_sha256").alias("text_sha256")), "prints")
    alone = groups.where("n = 1").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    copies = materialise(matched(fingerprints(docs, large, True, piece, prime), groups.where("n > 1").select("print", "n")).withColumn("row", F.monotonically_increasing_id()), "copies")
    odd = materialise(unequal(copies, piece), "odd")
    sums = [F.count("*").alias("n"), F.min(before()).alias("first")]
    rest = copies.drop("text", "n").join(odd, "row", "left_anti")
    found = join_hot(rest, materialise(rest.groupBy("print").agg(*sums).withColumn("size", F.col("n")), "classes"), "print").drop("print")
    others = copies.drop("print", "n").join(odd, "row", "left_semi")
    apart = others.join(others.groupBy("text").agg(*sums).withColumnRenamed("n", "size"), "text").drop("text")
    both = found.unionByName(apart)
    return alone.unionByName(both.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Only rows of groups with copies are looked up; where a row that stays is
    repeated, one of its rows remains.  Null and empty texts are copies of
    each other; an empty table gives an empty result.
    """
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ").cast("binary"), 256)
    found = materialise(exact_copies(docs).where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("rows")), "found")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), sha.alias("own_sha"))
    same = lambda part: F.col("own_id").eqNullSafe(part["doc_id"]) & (F.col("own_sha") == part["text_sha256"])
    moot = found.where("NOT stays OR rows > 1")
    again = found.where("stays AND rows > 1")
    once = rows.join(moot, same(moot), "left_anti")
    return once.select("row.*").unionByName(rows.join(again, same(again), "left_semi").dropDuplicates(["own_id", "own_sha"]).select("row.*"))


def op12_exact_dedup(docs: DataFrame) -> DataFrame:
    """The contract's result, one row for each document; see exact_copies for odd rows."""
    return exact_copies(docs)
