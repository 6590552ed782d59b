"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are compared inside blocks of candidates that share a key.  A
block stores bit planes vertically: plane ``p`` holds bit ``p`` of all its
fingerprints, 64 to a machine word.  One pass of XORs and carry-save adders
over the planes updates the distances of many rows to 64 others each, and
words whose pairs all exceed the radius drop out at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise
from .components import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 1 << 15
#: Words of 64 pairs that are compared at once.
ITEMS = 4096


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of the space-joined word shingles, repeats included."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def widen(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further independent 64 bits for each hash (a splitmix round)."""
    if lane == 0:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * lane & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """Majority bits as signed 64-bit lanes; no hashes: all zero."""
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), CHUNK):
            part = widen(hashes[at : at + CHUNK], lane).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, lanes: int = 1) -> DataFrame:
    """docs(doc_id, text) -> doc_id, f0 .. f{lanes-1}: 64 bits in each lane.

    Null and blank texts have the zero fingerprint.
    """
    names = [f"f{i}" for i in range(lanes)]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprint(shingle_hashes(t.as_py(), shingle, seed), lanes) for t in batch.column(1)]
            columns = np.array(rows, np.int64).reshape(-1, lanes).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(compute, schema)


def key_bits(lanes: int, radius: int, blocks: int) -> list[list[int]]:
    """Bit positions of each table's key.

    The bits are cut into ``blocks`` blocks, and every choice of ``blocks -
    radius`` of them is a table: fingerprints within the radius agree in one
    of the choices for certain.
    """
    parts = np.array_split(np.arange(64 * lanes), blocks)
    return [np.concatenate(c).tolist() for c in combinations(parts, blocks - radius)]


def unpack(lanes: list[np.ndarray]) -> np.ndarray:
    """Rows of bits, one column for each bit position."""
    return np.concatenate([np.unpackbits(x.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for x in lanes], axis=1)


def close_pairs(bits: np.ndarray, groups: np.ndarray, radius: int, labels: tuple[np.ndarray, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of the same group at most ``radius`` bits apart.

    bits: rows by bit positions; groups: non-decreasing group numbers.  A
    batch holds (row, word) items: one row against the 64 rows of a word of
    the bit planes.  Pairs of equal label in one of the arrays ``labels`` are
    left out; labels are read anew for each batch, so the caller may join them
    between batches, and items without a pair left cost nothing more.
    """
    n, width = bits.shape
    words = (n + 63) // 64
    padded = np.zeros((words * 64, width), np.uint8)
    padded[:n] = bits
    planes = np.ascontiguousarray(np.packbits(padded, axis=0, bitorder="little").T).view("<u8")
    counters = int(radius + 1).bit_length()
    begin = (1 << counters) - 1 - radius
    # the planes that split this block best come first, so that far pairs are given up early
    share = bits.mean(axis=0)
    order = np.argsort(np.abs(share - 0.5), kind="stable")
    order = order[: int(((share > 0) & (share < 1)).sum())]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    bounds = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if n else np.zeros(1, np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    first = (np.arange(n) + 1) // 64
    items = np.where(ends > np.arange(n) + 1, (ends - 1) // 64 - first + 1, 0)
    total = np.cumsum(items)
    low = 0
    while low < n:
        done = int(total[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(total, done + ITEMS, "right")))
        sizes = items[low:high]
        row = np.repeat(np.arange(low, high), sizes)
        word = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        other = word[:, None] * 64 + np.arange(64)
        valid = (other > row[:, None]) & (other < ends[row][:, None])
        for label in labels:
            valid &= label[np.minimum(other, n - 1)] != label[row][:, None]
        alive = np.packbits(valid, axis=1, bitorder="little").view("<u8").ravel()
        fill = np.where(bits[low:high].T, full, np.uint64(0))
        at = np.flatnonzero(alive)
        alive, row, word = alive[at], row[at], word[at]
        count = [np.full(len(at), full if begin >> k & 1 else 0, np.uint64) for k in range(counters)]
        for start in range(0, len(order) if len(at) else 0, 3):
            group = [planes[p][word] ^ fill[p][row - low] for p in order[start : start + 3]]
            if len(group) == 3:  # carry-save: three planes become a sum and a carry
                a, b, c = group
                half = a ^ b
                adds = [(half ^ c, 0), ((a & b) | (half & c), 1)]
            else:
                adds = [(x, 0) for x in group]
            for x, weight in adds:
                for k in range(weight, counters):
                    x, count[k] = count[k] & x, count[k] ^ x
                alive = alive & ~x
            if start % 9 == 6:
                keep = np.flatnonzero(alive)
                if len(keep) < len(alive):
                    alive, row, word, count = alive[keep], row[keep], word[keep], [c[keep] for c in count]
                if not len(alive):
                    break
        if len(alive):
            item, bit = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield row[item], word[item] * 64 + bit
        low = high


def find(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def flatten(root: np.ndarray) -> None:
    """Every row's label becomes its root, in place."""
    while (root[root] != root).any():
        root[:] = root[root]


def fresh(i: np.ndarray, j: np.ndarray, root: np.ndarray, step: int = 256) -> Iterator[tuple[int, int]]:
    """The pairs whose roots differ, looked at again after each slice, so that few are left once rows are joined."""
    while len(i):
        yield from zip(i[:step].tolist(), j[:step].tolist(), strict=True)
        flatten(root)
        i, j = i[step:], j[step:]
        new = root[i] != root[j]
        i, j, step = i[new], j[new], step * 2


def spanning_links(bits: np.ndarray, groups: np.ndarray, radius: int, sides: np.ndarray | None = None) -> np.ndarray:
    """For each row the smallest row that its group's close pairs reach."""
    root = np.arange(len(bits))
    for i, j in close_pairs(bits, groups, radius, (root,) if sides is None else (root, sides)):
        for a, b in fresh(i, j, root):
            a, b = find(root, a), find(root, b)
            if a != b:
                root[max(a, b)] = min(a, b)
    return root


def cells(rows: DataFrame, chunks: DataFrame, rep: str) -> DataFrame:
    """rows(t, key, ..), chunks(t, key, chunks) -> rows + cell, side.

    Rows of a key are dealt over its chunks by ``rep``, and a cell is made
    for each pair of chunks, so no task gets a whole hot key.  Within a cell
    only rows of different sides are compared: all rows, or the two chunks.
    """
    mine = F.pmod(F.xxhash64(rep), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = rows.join(chunks, ["t", "key"]).withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.withColumn("cell", F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other")))
    return dealt.withColumn("side", F.when(F.col("mine") != F.col("other"), F.col("mine"))).drop("t", "key", "chunks", "mine", "other")


def by_cell(batches: Iterator[pa.RecordBatch], size: int = 4096, most: int = 1 << 24) -> Iterator[pa.Table]:
    """Tables of whole cells from batches sorted by cell, of about ``size`` rows or ``most`` bytes where cells allow."""
    held: list[pa.Table] = []
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            held.append(pa.Table.from_batches([batch.slice(at, size)]))
            if sum(map(len, held)) < size and sum(t.nbytes for t in held) < most:
                continue
            table = pa.concat_tables(held).combine_chunks()
            cell = table.column("cell").to_numpy()
            cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            if cuts.size:
                yield table.slice(0, cuts[-1])
                table = table.slice(cuts[-1])
            held = [table]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def cell_arrays(table: pa.Table, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits, cell and side of each row; rows without a side each have their own."""
    bits = unpack([table.column(f"f{k}").to_numpy() for k in range(lanes)])
    side = table.column("side").fill_null(-1).to_numpy()
    return bits, table.column("cell").to_numpy(), np.where(side < 0, -1 - np.arange(len(side)), side)


def near_links(prints: DataFrame, lanes: int, radius: int, blocks: int = 5, block_rows: int = 2048) -> DataFrame:
    """prints(rep, f0..): distinct fingerprints -> links (a, b) between reps.

    The links span every component of the pairs within the radius.
    """
    names = [f"f{i}" for i in range(lanes)]
    positions = key_bits(lanes, radius, blocks)
    kind = dict(prints.dtypes)["rep"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = unpack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(lanes)]) if batch.num_rows else np.zeros((0, 64 * lanes), np.uint8)
            for t, own in enumerate(positions):
                key = bits[:, own].astype(np.int64) @ (np.int64(1) << np.arange(len(own), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), *batch.columns], ["t", "key", "rep", *names])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            bits, cell, side = cell_arrays(table, lanes)
            root = spanning_links(bits, cell, radius, side)
            own = np.flatnonzero(root != np.arange(len(root)))
            rep = table.column("rep").combine_chunks()
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(root[own])), rep.take(pa.array(own))], ["a", "b"])

    lanes_sql = ", ".join(f"{n} long" for n in names)
    rows = prints.select("rep", *names).mapInArrow(keyed, f"t int, key long, rep {kind}, {lanes_sql}")
    chunks = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / block_rows).cast("int").alias("chunks"))
    placed = cells(rows, chunks, "rep").select("cell", "side", "rep", *names).repartition("cell").sortWithinPartitions("cell")
    return placed.mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, lanes: int = 1, radius: int = 3, blocks: int = 5, block_rows: int = 2048) -> DataFrame:
    """docs(doc_id, text) -> doc_id, f0.., component_id, one row per input row.

    Texts whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest doc_id that links reach; no link is
    missed.  Equal fingerprints are gathered before any comparison, so copies
    never meet pairwise; the fingerprint itself is the node that is linked,
    so rows with a null doc_id link others like any row.  Null and blank
    texts share the zero fingerprint; a group without any doc_id has a null
    component; repeated rows stay repeated; other columns are not read.
    """
    names = [f"f{i}" for i in range(lanes)]
    whole = F.concat(*[F.unhex(F.lpad(F.hex(n), 16, "0")) for n in names]) if lanes > 1 else F.col("f0")
    prints = materialise(fingerprints(docs, shingle, seed, lanes).withColumn("rep", whole), "fingerprints")
    distinct = materialise(prints.groupBy("rep", *names).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    parts = connected_components(near_links(distinct, lanes, radius, blocks, block_rows))
    linked = materialise(distinct.join(parts, distinct["rep"] == parts["node"]).select("rep", "least", "component"), "linked")
    sizes = materialise(linked.groupBy("component").agg(F.count("*").alias("n"), F.min("least").alias("component_id")), "sizes")
    named = join_hot(linked.select("rep", "component"), sizes, "component").select(F.col("rep").alias("node"), "component_id")
    known = distinct.join(named, F.col("rep") == F.col("node"), "left").select("rep", "n", F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return join_hot(prints, materialise(known, "known"), "rep").select("doc_id", *names, "component_id")


def op5_simhash(docs: DataFrame) -> DataFrame:
    """The contract's result: doc_id, fingerprint (hex), component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
