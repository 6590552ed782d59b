"""Token-ID output: ids packed in the fewest bits of the vocabulary.

File format.  A table in the shared folder, in ascending doc_id order, whose
rows hold runs of documents.  ``data`` of a row is a byte string:

    magic "QTB1", bits (u32), ids per block (u32), ids (u64), blocks (u32),
    byte offset of each block (u64 each, from the end of this header),
    the blocks: ids one after another, lowest bit first, each block padded
    to whole bytes

so any range of ids is found from the block offsets and unpacked with numpy
without touching other blocks.  ``doc_ids`` and ``ends`` give the documents.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path

MAGIC = b"QTB1"
HEAD = struct.Struct("<4sIIQI")
BLOCK_IDS = 4096
ROW_DOCS, ROW_IDS = 512, 1 << 20
#: Documents and bytes of text that are encoded together.
TURN_DOCS, TURN_BYTES, GATHER_DOCS = 8192, 16 << 20, 256
#: Pieces whose ids a worker remembers: those used last and more than once in a turn, in two generations that begin anew beyond this many.
CACHE_PIECES = 200_000
#: Pieces that go to the library as one text.
JOINED_PIECES = 10_000
#: White space other than the space and the line end.
OTHER_SPACE = "".join(c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n")
#: Stands before the first piece of a text, which has no space in front.
FIRST = "\t"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def encode_row(ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    blocks = [pack(ids[at : at + block_ids], bits) for at in range(0, len(ids), block_ids)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8")
    return b"".join([HEAD.pack(MAGIC, bits, block_ids, len(ids), len(blocks)), offsets.tobytes(), *blocks])


def read_ids(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start..stop of a row; only the blocks that hold them are unpacked."""
    magic, bits, block_ids, n_ids, n_blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    stop = n_ids if stop is None else min(stop, n_ids)
    if start >= stop:
        return np.empty(0, np.uint32)
    offsets = np.frombuffer(data, "<u8", n_blocks, HEAD.size)
    body = memoryview(data)[HEAD.size + 8 * n_blocks :]
    first, last = start // block_ids, (stop - 1) // block_ids
    parts = [unpack(body[int(offsets[b]) :], min(block_ids, n_ids - b * block_ids), bits) for b in range(first, last + 1)]
    return np.concatenate(parts)[start - first * block_ids : stop - first * block_ids]


class PieceEncoder:
    """Encodes with the tokenizers library, remembering the ids of pieces.

    A byte-level BPE of the usual word pattern never merges across a space
    or line end that stands alone between two other characters, so a text
    is the sequence of its pieces there.  Texts with longer runs or other
    kinds of white space, or with an added token, go to the library whole, as
    all texts do if the tokenizer's file describes anything else.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.bits = max(1, (self.library.get_vocab_size() - 1).bit_length())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        added = "".join(f"|{re.escape(t['content'])}" for t in described["added_tokens"])
        self.whole_pattern = f"[{OTHER_SPACE}]|[ \n][ \n]|\\A[ \n]|[ \n]\\z{added}"
        self.parted = self._cuts_words(described)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts_words(self, described: dict) -> bool:
        """Whether the tokenizer's file says that words are encoded on their own.

        That holds for BPE without a normaliser, without chance, and with the
        byte-level word pattern as its only cut, if a line end is one id and
        added tokens hold no white space and take none beside them.
        """
        cut = described.get("pre_tokenizer") or {}
        words = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        plain = described["model"].get("type", "BPE") == "BPE" and not described["model"].get("dropout") and not described.get("normalizer") and not described.get("truncation")
        apart = all(not (t["lstrip"] or t["rstrip"]) and t["content"] and not any(c.isspace() for c in t["content"]) for t in described["added_tokens"])
        if not (words and plain and apart) or len(ids := self._whole(["\n"])[0]) != 1:
            return False
        self.line_end = ids[0]
        return True

    def separable(self, texts: pa.Array) -> pa.Array:
        """Whether all white space is single spaces and line ends between other characters, and no added token is in the text."""
        return pc.invert(pc.match_substring_regex(texts, self.whole_pattern))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: many to a text, a line for each, cut at the line ends.

        A first piece of a text and one after a line end stand at the start
        of their line, the others after the space that belongs to them.
        """
        shown = [p[1:] if p[0] in (FIRST, "\n") else " " + p for p in pieces]
        out = []
        for at in range(0, len(shown), JOINED_PIECES):  # what the library returns is much larger than the ids
            [ids] = self._whole(["\n".join(shown[at : at + JOINED_PIECES])])
            found = np.array(ids, "<u4")
            ends = np.append(np.flatnonzero(found == self.line_end), len(found)) * 4
            data = found.tobytes()
            out += [data[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)]
        first = np.uint32(self.line_end).tobytes()
        return [first + x if p[0] == "\n" else x for p, x in zip(pieces, out, strict=True)]

    def _known(self, pieces: list[str], often: np.ndarray) -> list[bytes]:
        """Ids of different pieces; what is new in all of them goes to the library at once, and what occurs ``often`` is remembered."""
        if len(self.young) > CACHE_PIECES:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = [young.get(p) or old.get(p) for p in pieces]
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, self._pieces([pieces[k] for k in new]), strict=True) if new else ():
            found[k] = ids
        young.update((pieces[k], found[k]) for k in np.flatnonzero(often)[: 2 * CACHE_PIECES - len(young)].tolist())
        return found

    def _parted(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of separable texts, none empty: their different pieces are encoded and put in the places of all."""
        marked = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        places = coded.indices.to_numpy()
        ids = self._known(coded.dictionary.to_pylist(), np.bincount(places) > 1)
        sizes = np.array([len(x) // 4 for x in ids], np.int32)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out: list[np.ndarray] = []
        for at in range(0, len(texts), GATHER_DOCS):  # a few at a time, to keep the arrays small
            own = offsets[at : at + GATHER_DOCS + 1]
            part = places[own[0] : own[-1]]
            counts = sizes[part]
            ends = np.cumsum(counts, dtype=np.int32)
            found = flat[np.repeat(begins[part] - (ends - counts), counts) + np.arange(ends[-1], dtype=np.int32)]
            out += np.split(found, np.r_[np.int32(0), ends][own[1:-1] - own[0]])
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text.

        Pieces are remembered without the space before them; a text's first
        piece has none, and is remembered with a mark in front to tell it apart.
        """
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        filled = pc.greater(pc.fill_null(pc.binary_length(column), 0), 0)
        parted = pc.and_(filled, self.separable(pc.fill_null(column, ""))) if self.parted else pa.array(np.zeros(len(column), bool))
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(column)
        places = np.flatnonzero(parted.to_numpy(zero_copy_only=False))
        if len(places):
            for k, ids in zip(places.tolist(), self._parted(column.take(pa.array(places))), strict=True):
                out[k] = ids
        odd = np.flatnonzero(pc.and_not(filled, parted).to_numpy(zero_copy_only=False))
        for k, ids in zip(odd.tolist(), self._whole(column.take(pa.array(odd)).to_pylist()), strict=True):
            out[k] = np.array(ids, np.uint32)
        return out


@cache
def worker_encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker, so that tasks share what it remembers."""
    return PieceEncoder(path)


def turns(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (doc_id, text) in slices of TURN_DOCS rows and about TURN_BYTES at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for k, size in enumerate(sizes.tolist()):
        if k > begin and (held + size > TURN_BYTES or k - begin >= TURN_DOCS):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> str:
    """Encode docs(doc_id, text), append ``end_id`` to each, and write the files.

    Rows are dealt by ranges of doc_id and a hash of the text, so equal ids
    that fill a range are split as well.  A null or empty text is the end id
    alone; null doc_ids come first; repeated rows stay repeated; other
    columns are not read.  Returns the path of the table.
    """
    path = path or new_path(docs.sparkSession, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = worker_encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        count, row = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal row, start, count
            ids = np.concatenate(held)
            ends = np.cumsum([len(x) for x in held])
            columns = [pa.array([part], pa.int32()), pa.array([row], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([names[:]], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([encode_row(ids, encoder.bits)], pa.binary())]
            row, start, count = row + 1, start + len(ids), 0
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "row", "start", "n_ids", "doc_ids", "ends", "data"])

        for batch in batches:
            for turn in turns(batch):
                for doc_id, ids in zip(turn.column(0).to_pylist(), encoder.encode(turn.column(1)), strict=True):
                    names.append(doc_id)
                    held.append(np.append(ids, np.uint32(end_id)))
                    count += len(ids) + 1
                    if len(names) >= ROW_DOCS or count >= ROW_IDS:
                        yield flush()
        if names:
            yield flush()
        pa.default_memory_pool().release_unused()  # the worker lives on

    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows = ordered.mapInArrow(encode, "part int, row long, start long, n_ids long, doc_ids array<long>, ends array<long>, data binary")
    rows.write.option("compression", "zstd").parquet(path)
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """Documents of a token table: doc_id, start, n_tokens, ids_crc32.

    One row for each document written, null and repeated doc_ids included; a
    table without documents gives an empty result.
    """
    stored = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each written part, not for each document
    bases = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, names, ends, data in zip(*(batch.column(k) for k in range(5)), strict=True):
                ids = read_ids(data.as_py()).astype("<u4")
                ends = np.array(ends.as_py(), np.int64)
                begins = np.r_[0, ends[:-1]]
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names.as_py(), pa.int64()), pa.array(np.full(len(ends), part.as_py(), np.int32)), pa.array(begins + start.as_py()), pa.array(ends - begins), pa.array(sums, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    docs = stored.select("part", "start", "doc_ids", "ends", "data").mapInArrow(decode, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return docs.join(bases, "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op2_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of ``docs`` and describe each document from them."""
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer))
