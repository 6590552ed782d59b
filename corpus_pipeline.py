"""The corpus pipeline: quality, near-duplicates, contamination, mixture, tokens.

All stages take an empty table, and give one.  Rows with a null doc_id are
documents like others, but no one's copies; null and empty texts fail the
quality rules; repeated rows are judged alike until one of them stays; columns
beside doc_id, text and source come along unread, whatever their names, but
n_chars, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, new_path, read_table, scratch
from quillspark.llm.copies import keep_one
from quillspark.llm.decontam import clean_documents
from quillspark.llm.mixing import mixed_documents
from quillspark.llm.quality import kept_documents
from quillspark.llm.queries import TOKENIZER
from quillspark.llm.tokens import op2_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject, and cut lines that are too frequent at their source."""
    kept = kept_documents(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources meet their target weights."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and describe each document from them."""
    return op2_tokens(docs, TOKENIZER)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Fingerprint groups and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again.

    What a stage writes on its way is deleted once its result is written.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark, name):
            docs = materialise(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
