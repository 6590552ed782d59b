"""Benchmark decontamination by a prefix-filtered join of word windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: ASCII letters and digits and all bytes of other characters are word bytes.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Items of one scan of the documents: about this many bytes of text, some four times that in a worker.
SCAN_BYTES = 128 << 20
#: Candidate windows that are compared at once.
CANDIDATES = 1 << 19

SPANS = "array<struct<begin:long,end:long>>"


def word_list(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Windows:
    """The windows of items, found through their rarest word.

    A document holds a window only if it holds the window's rarest word (the
    one prefix token that full containment needs), so only those words are
    looked up.  Their place in the window fixes where it would start.

    The items' words stand one after another as numbers; a window is the
    place of its first word there, so it costs no more than a few bytes.
    """

    def __init__(self, items: Iterable[tuple[str | None, bytes | None]], window: int) -> None:
        self.names: list[str | None] = []
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        parts, known = [np.empty(0, np.int32)], self.vocabulary
        for name, text in items:
            self.names.append(name)
            parts.append(np.array([number(w, len(known)) for w in word_list(text)], np.int32))
        lengths = np.array([len(x) for x in parts[1:]], np.int64)
        self.words = np.concatenate(parts)
        sizes = np.minimum(lengths, window)
        per = np.where(sizes > 0, lengths - sizes + 1, 0)
        skip = np.repeat(np.cumsum(lengths) - lengths - np.cumsum(per) + per, per)
        self.starts = (skip + np.arange(per.sum())).astype(np.int32 if len(self.words) < 1 << 31 else np.int64)
        self.owners = np.repeat(np.arange(len(lengths), dtype=np.int32), per)
        self.lengths = np.repeat(sizes.astype(np.uint8 if window < 256 else np.int32), per)
        self.window = window

    def order_by_rarity(self, counts: np.ndarray) -> None:
        """counts: how often each word of the vocabulary occurs in all documents."""
        rank = np.empty(len(counts) + 1, np.int32)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        rank[-1] = len(counts)  # of no word
        best = np.full(len(self.starts), len(counts) + 1, np.int32)
        self.offsets = np.zeros(len(self.starts), np.uint8 if self.window < 256 else np.int32)
        for k in range(self.window):
            inside = k < self.lengths
            own = rank[np.where(inside, self.words[np.minimum(self.starts + k, len(self.words) - 1)], -1)] if len(best) else best
            self.offsets[own < best] = k
            np.minimum(best, own, out=best)
        prefix = self.words[self.starts + self.offsets]
        self.by_prefix = np.argsort(prefix, kind="stable").astype(np.int32)
        # the last entry stands for words outside the vocabulary (-1)
        self.n_by_word = np.bincount(prefix, minlength=len(counts) + 1).astype(np.int64)
        self.first = np.cumsum(self.n_by_word) - self.n_by_word

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and window numbers of all occurrences in a document."""
        starts, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        per = self.n_by_word[ids]
        places = np.flatnonzero(per)
        sums = np.cumsum(per[places])
        at = 0
        while at < len(places):
            # a slice of places with a bounded number of candidates, one place at least
            end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + CANDIDATES, "right")))
            place, n = places[at:end], per[places[at:end]]
            place = np.repeat(place, n)
            rank = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            window = self.by_prefix[np.repeat(self.first[ids[places[at:end]]], n) + rank]
            start = place - self.offsets[window]
            fits = (start >= 0) & (start + self.lengths[window] <= len(ids))
            start, window = start[fits], window[fits]
            for k in range(self.window):
                if not len(start):
                    break
                inside = k < self.lengths[window]
                want = self.words[np.where(inside, self.starts[window] + k, 0)]
                same = ~inside | (ids[np.minimum(start + k, len(ids) - 1)] == want)
                start, window = start[same], window[same]
            starts.append(start)
            windows.append(window)
            at = end
        return np.concatenate(starts), np.concatenate(windows)


def encoded(vocabulary: dict[bytes, int], text: bytes | None) -> np.ndarray:
    """Numbers of a text's words, -1 for those of no item."""
    get = vocabulary.get
    return np.array([get(w, -1) for w in word_list(text)], np.int32)


def word_counts(docs: DataFrame, shared: Broadcast, size: int) -> np.ndarray:
    """How often each word of the vocabulary occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, encoded(own, text.as_py()) + 1, 1)
        seen = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[1:][seen])], ["word", "n"])

    found = docs.select(F.col("text").cast("binary")).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found.column("word").to_numpy()] = found.column("n").to_numpy()
    return counts


def scan(docs: DataFrame, items: Iterable[tuple[str | None, bytes | None]], window: int, with_text: bool = False) -> DataFrame:
    """docs(doc_id, text, ..) -> its other columns, n_words, spans, items, in one pass after one that counts words."""
    context = docs.sparkSession.sparkContext
    windows = Windows(items, window)
    vocabulary, windows.vocabulary = windows.vocabulary, {}
    words = context.broadcast(vocabulary)
    windows.order_by_rarity(word_counts(docs, words, len(vocabulary)))
    ordered = context.broadcast(windows)
    names = [c for c in docs.columns if c != "text"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = words.value, ordered.value
        for batch in batches:
            n_words, all_spans, all_items = [], [], []
            for text in batch.column(0):
                ids = encoded(known, text.as_py())
                start, found = own.find(ids) if len(ids) and len(own.starts) else (np.empty(0, np.int64),) * 2
                spans, named = [], []
                if len(start):
                    edge = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + own.lengths[found], -1)
                    turns = np.flatnonzero(np.diff(np.r_[0, np.cumsum(edge) > 0, 0]))
                    spans = [{"begin": int(b), "end": int(e)} for b, e in turns.reshape(-1, 2)]
                    named = sorted({x for i in np.unique(own.owners[found]) if (x := own.names[i]) is not None})
                n_words.append(len(ids))
                all_spans.append(spans)
                all_items.append(named)
            found_columns = [pa.array(n_words, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(all_items, pa.list_(pa.string()))]
            texts = [batch.column(0)] if with_text else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found_columns, *texts], [*names, "n_words", "spans", "items", *["text" for _ in texts]])

    empty = {"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")}
    schema = docs.select(*names).withColumns(empty | ({"text": F.lit("").cast("binary")} if with_text else {})).schema
    for field in schema:
        field.nullable = True
    return docs.select(F.col("text").cast("binary").alias("text"), *names).mapInArrow(find, schema)


def merged_spans(lists: Column) -> Column:
    """Spans of several lists as one list of ranges that do not overlap."""
    start = F.array().cast(SPANS)

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        wider = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(-1)) >= x["begin"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(wider))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(F.flatten(lists)), start, step)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, scan_bytes: int = SCAN_BYTES, carry: bool = False) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, n_words, spans, items.

    spans: the merged word ranges [begin, end) that lie in an occurrence of a
    window of ``window`` consecutive item words (a shorter item is one window);
    items: the distinct ids, sorted as strings, of the items found.

    A null or wordless text has no words and no spans; so has an item.  Items
    without an id mark words but are not named.  Repeated rows stay; an empty
    table on either side is no error; other columns are not read, whatever
    their names, unless ``carry`` asks for them: then ``kept`` holds them all.

    A benchmark of up to ``scan_bytes`` is found in one scan of the documents.
    A larger one takes a scan for each such part; the hits of a scan, known by
    doc_id and a digest of the text, are written and put together in the end.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // scan_bytes))
    pick = lambda b: items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == b)
    rows = lambda b: ((r.item, None if r.text is None else bytes(r.text)) for r in pick(b).toLocalIterator())
    if parts == 1:
        others = [F.struct(*[c for c in docs.columns if c != "text"]).alias("kept")] if carry else []
        found = scan(docs.select("doc_id", *others, "text"), rows(0), window, carry)
        kept = [F.col("text").cast("string").alias(c) if c == "text" else F.col("kept")[c].alias(c) for c in docs.columns]
        return found.withColumn("kept", F.struct(*kept)).drop("text") if carry else found
    kept = [F.struct(*docs.columns).alias("kept")] if carry else []
    keyed = docs.select("doc_id", F.md5("text").alias("text_md5"), *kept, "text")
    hits = [materialise(scan(keyed.select("doc_id", "text_md5", "text"), rows(b), window).where(F.size("spans") > 0).distinct(), "hits") for b in range(parts)]
    merged = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "text_md5").agg(merged_spans(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = materialise(merged, "hits").select(F.col("doc_id").alias("hit_id"), F.col("text_md5").alias("hit_md5"), "spans", "items")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_md5") == F.col("hit_md5"))
    sized = keyed.withColumn("n_words", F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long")).drop("text")
    found = sized.join(merged, same, "left")
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    return found.select("doc_id", *["kept" for _ in kept], F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), empty("spans", SPANS), empty("items", "array<string>"))


def op6_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's result, one row for each document."""
    found = contaminated_spans(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Documents without any benchmark window, with all their columns.

    Null and empty texts hold none and stay; repeated rows are judged alike,
    null doc_ids are no matter; without items all stay, and an empty table
    gives an empty result.
    """
    found = contaminated_spans(docs, benchmark, window, carry=True)
    return found.where(F.size("spans") == 0).select("kept.*")
