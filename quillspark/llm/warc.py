"""Web archives: writing, reading back, and merging their capture indexes."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path

#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: An archive is closed once its records have this many bytes.
ARCHIVE_BYTES = 64 << 20
#: The time of a capture that has none.
CAPTURED = "2024-01-01 00:00:00"
ID = "urn:quillspark:page:"
END = "\r\n\r\n"


def first_captures(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Digests of payloads of ``least`` bytes or more that several rows have: digest, first."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.length(payload).alias("bytes"))
    seen = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    return seen.where("n > 1 AND first IS NOT NULL").select("digest", "first")


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a task -> record and the number of its archive, which goes up once ARCHIVE_BYTES are reached."""
    at = archive = 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
        numbers = np.empty(len(sizes), np.int32)
        for k, size in enumerate(sizes.tolist()):
            numbers[k] = archive
            at += size
            if at >= ARCHIVE_BYTES:
                at, archive = 0, archive + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers)], ["value", "archive"])


def write_warc(pages: DataFrame, captured: str | Column = CAPTURED, path: str | None = None, compression: str = "gzip") -> str:
    """Write pages(page_id, url, html) as WARC 1.1 files; returns the folder.

    Each part file of Spark's text writer is an archive: its "lines" are whole
    records and its line separator is the blank line that ends a record.  An
    archive holds ARCHIVE_BYTES and a record at most.  A payload seen before
    (with a smaller page_id) is a revisit record with the HTTP head alone.
    ``captured`` is the time of all captures, or a column of ``pages`` with
    the time of each.  With ``compression`` "none" the places in the index are
    places in the file; with "gzip", in its one stream of decompressed bytes.

    A null html is an empty payload, a null url is left out of its record, a
    null page_id gives a record without a number, a null time is CAPTURED;
    rows that share a page_id share a record id; no pages give no archive.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    firsts = materialise(first_captures(pages), "firsts")
    html = F.coalesce(F.col("html"), F.lit(""))
    time = F.coalesce((F.lit(captured) if isinstance(captured, str) else captured).cast("timestamp"), F.lit(CAPTURED).cast("timestamp"))
    rows = pages.select("page_id", "url", html.alias("html"), time.alias("captured")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    rows = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("first") == F.col("page_id"), F.lit(False))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    date = F.date_format(F.to_utc_timestamp("captured", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: "), date,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.lit(f"\r\nWARC-Refers-To: <{ID}"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(head) + F.when(revisit, 0).otherwise(F.octet_length("html"))).cast("string"),
        F.lit(END), head, F.when(revisit, "").otherwise(F.col("html")),
    )
    records = rows.select(record.alias("value")).mapInArrow(numbered, "value string, archive int")
    records.write.partitionBy("archive").option("lineSep", END).option("compression", compression).text(path)
    return path


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin = end + 4
        stop = begin + int(headers["Content-Length"])
        yield headers, data[begin:stop], at, stop + 4 - at
        at = stop + 4


def url_key(url: str | None) -> str:
    """Sort-friendly form: the host's labels reversed, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    host = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


class LoserTree:
    """Merges sorted runs; each step replays one path from leaf to root."""

    def __init__(self, runs: list[Iterable[tuple]]) -> None:
        self.sources = [iter(r) for r in runs]
        self.heads = [next(s, None) for s in self.sources]
        self.k = len(self.sources)
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:  # an empty place wins, so that leaves fill the tree
            return a < 0
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[winner := self.losers[0]]) is not None:
            yield head
            self.heads[winner] = next(self.sources[winner], None)
            self._replay(winner)


INDEX = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"


def read_runs(spark, path: str) -> DataFrame:
    """Read archives back: one index run for each, sorted by URL key and time."""

    def page(name: str | None) -> int | None:
        number = name.removeprefix(f"<{ID}").removesuffix(">") if name else ""
        return int(number) if number else None

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                data = content.as_py()
                for headers, block, offset, length in parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = headers["WARC-Type"]
                    size = int(re.search(rb"(?m)^Content-Length: (\d+)", head)[1])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: record at byte {offset} is damaged")
                    url = headers.get("WARC-Target-URI")
                    rows.append((url_key(url), headers["WARC-Date"], page(headers["WARC-Record-ID"]), url, kind, page(headers.get("WARC-Refers-To")), size, digest, name, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], r[9]))
                columns = list(zip(*rows, strict=True)) or [()] * 11
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(index, INDEX)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Index runs -> capture histories ordered by URL key and time over all partitions.

    Ranges of (URL key, time, archive, offset) go to one task each, so a URL
    with very many captures spans several; there the runs of the archives
    meet in a loser tree.  A task holds its range as Arrow columns; the tree
    reads the keys of each run as it goes and tells the order of the rows.
    """
    order = ["url_key", "captured", "archive", "offset"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        archive = table.column("archive").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.r_[0, np.flatnonzero(np.diff(archive)) + 1, len(table)]

        def keys(begin: int, end: int) -> Iterator[tuple]:
            for at in range(begin, end, 1000):
                part = table.slice(at, min(1000, end - at))
                yield from zip(*[part.column(n).to_pylist() for n in order], range(at, at + len(part)), strict=True)

        merged = (x[-1] for x in LoserTree([keys(a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]))
        while rows := list(islice(merged, 10_000)):
            yield from table.take(pa.array(rows)).combine_chunks().to_batches()

    ranged = runs.repartitionByRange(*order).sortWithinPartitions("archive", *order[:2], "offset")
    return ranged.mapInArrow(merge, INDEX)


def op8_warc(pages: DataFrame) -> DataFrame:
    """Archive the pages, read the archives back, and describe every capture.

    The runs of the archives are written to the shared folder and merged from
    there.  A null html is an empty payload, a null url has the empty URL key,
    rows with a null page_id are written without a number; repeated rows are
    separate records, all response if their page_id is the smallest.
    """
    path = write_warc(pages)
    runs = materialise(read_runs(pages.sparkSession, path), "runs")
    return merge_runs(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
