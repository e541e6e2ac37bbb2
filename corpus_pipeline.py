"""The corpus pipeline: five stages, each an operator of embergrid.llm, from raw documents to token ids.

Defined cases of every stage: null and empty texts go in the first stage (they have under 20 words), and where a later
stage meets one by itself it has no duplicates but its equals, no benchmark passage, no secret and no ids; texts are read
whole, however long; doc_id need not be a key, and may be null; an empty table gives an empty one; columns beside those
of documents are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.llm.common import cut, table
from embergrid.llm.decontaminate import decontaminate
from embergrid.llm.near_dedup import drop_near_duplicates
from embergrid.llm.quality_rules import quality_rules
from embergrid.llm.secret_scan import secret_scan
from embergrid.llm.sentencepiece_codec import sentencepiece_encode

#: Columns of documents; every stage but the last returns them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REST = ("doc_id", "lang", "source")


def _with_text(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail the base rules or lose too much text go whole. Repeated rows go or stay alike."""
    return _with_text(quality_rules(docs, carry=_REST, with_text=True, only_kept=True), "clean_text")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id, among equal ids the least text hash."""
    return drop_near_duplicates(docs.select(*COLUMNS)).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. Without a benchmark item all stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS, only_clean=True).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text give way to a mark of their kind; of overlapping ones the first names the mark."""
    return _with_text(secret_scan(docs, carry=_REST, with_text=True), "redacted_text")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, verified against the sentencepiece library and by decoding; one row a document, a null text has no ids."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_encode(docs, path, carry=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("quality_rules", filter_quality),
    ("near_dedup", deduplicate),
    ("decontaminate", remove_benchmark),
    ("secret_scan", redact_secrets),
    ("sentencepiece", tokenize),
]

#: No SQL: the near-duplicate stage and the tokenizer can't be expressed; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet in the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
