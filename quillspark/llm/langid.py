"""Language shares of documents by expectation-maximisation over n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of each language that the model is learned from, in expectation.
SAMPLE_DOCS = 4000
#: Hashed trigrams; a model has at most this many numbers for each language.
BUCKETS = 1 << 16
#: EM has settled once no share moves by more than this in a round.
SETTLED = 1e-4


@cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str | None) -> np.ndarray:
    """Hashed trigrams of lower-cased letters, with word ends as one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    spaced = np.where(is_letter, points, 32).astype(np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    seq = np.concatenate([[np.uint64(32)], spaced[keep], [np.uint64(32)]])
    mixed = seq[:-2] * np.uint64(0x9E3779B97F4A7C15) + seq[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + seq[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)


class Model:
    """log P(trigram | language), smoothed towards the languages' mean."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        if languages:
            mean = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
            strength = 50.0
            share = (counts + strength * mean) / (counts.sum(axis=1, keepdims=True) + strength)
            self.log = np.log(share).astype(np.float32)

    @staticmethod
    def mixture(p: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
        """EM for the shares, until they settle; p: P(gram | language) up to a factor for each gram.

        The likelihood rises with every round, so the rounds come to an end.
        """
        share = np.full(len(p), 1 / len(p))
        while len(p) > 1:
            joint = share[:, None] * p
            new = (joint / joint.sum(axis=0)) @ weight
            new /= new.sum()
            moved, share = np.abs(new - share).max(), new
            if moved < SETTLED:
                break
        return share, float(np.log(share @ p) @ weight)

    def predict(self, text: str | None) -> tuple[str, float, list[str]]:
        """The leading language of the chosen set, its share there, and the set.

        Languages enter the set in the order of their shares among all as long
        as the likelihood, less a penalty of two log n for each, still rises.
        """
        found = grams(text)
        if not len(found) or not self.languages:
            return "und", 0.0, []
        if len(found) < 20_000:
            unique, weight = np.unique(found, return_counts=True)
        else:
            weight = np.bincount(found, minlength=BUCKETS)
            unique = np.flatnonzero(weight)
            weight = weight[unique]
        log = self.log[:, unique].astype(np.float64)
        p = np.maximum(np.exp(log - log.max(axis=0)), 1e-300)
        share, _ = self.mixture(p, weight)
        order = np.argsort(-share, kind="stable")
        penalty = 2 * np.log(len(found) + 1)
        chosen = order[:1]
        shares, best = self.mixture(p[chosen], weight)
        for size in range(2, len(order) + 1):
            own, now = self.mixture(p[order[:size]], weight)
            if now - penalty <= best:
                break
            chosen, shares, best = order[:size], own, now
        rank = np.argsort(-shares, kind="stable")
        return self.languages[chosen[rank[0]]], float(min(1.0, shares[rank[0]])), [self.languages[k] for k in chosen[rank]]


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 5) -> Model:
    """labelled(doc_id, text, lang) -> Model, from about ``sample_docs`` whole texts of each language.

    Rows are drawn by doc_id and text, so an id that stands for many texts is
    no larger a draw; the row with the least draw is always in, so that each
    language has one; equal rows count once.  Rows without a text or language
    are left out.  The driver gets one row for each language and at most
    BUCKETS counts for each.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang", draw.alias("draw"))
    sizes = {r.lang: (r.n, r.least) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()}
    if not sizes:
        return Model([], np.empty((0, BUCKETS)))
    limits = F.create_map(*[F.lit(x) for lang, (n, least) in sizes.items() for x in (lang, max(int(sample_docs / n * (1 << 30)), least))])
    sample = labelled.where(F.col("draw") <= limits[F.col("lang")]).dropDuplicates(["doc_id", "text", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(grams(text.as_py()), minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    table = sample.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(languages), BUCKETS))
    place = {lang: k for k, lang in enumerate(languages)}
    rows = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[rows, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, languages, in one pass.

    A null text, one without letters, or an empty model gives ``und``, score 0
    and no languages.  Only the text is looked at; repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, lang_pred string, score double, languages array<string>")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op3_langid(docs: DataFrame) -> DataFrame:
    """The contract's result; held-out rows are never learned from."""
    model = learn(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
