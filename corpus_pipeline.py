"""Documents through quality rules, near-duplicate removal, repeated-passage removal, secret redaction and packing.

Each stage works on all that the one before it kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm.minhash import one_of_each
from tracemill.llm.packing import pack
from tracemill.llm.quality import kept_documents
from tracemill.llm.secrets import redacted_documents
from tracemill.llm.suffix import trimmed_documents
from tracemill.session import discard, settle, table, written

#: Bytes of a repeated passage. Fifty words of natural text with their spaces have over 200 bytes; shorter repeats are phrases.
PASSAGE = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy web, version 2 rejects go. Null and empty texts have no words and go; an empty table stays empty."""
    settle(spark)
    return kept_documents(docs, "web", 2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 connect, the document with the smallest id stays, with all rows of that id; so do rows without an id or words."""
    return one_of_each(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a string of PASSAGE bytes that starts anywhere else too are taken out of the texts; every document stays, a null text null."""
    return trimmed_documents(docs, PASSAGE)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become [SECRET]; every document stays, a null text null."""
    return redacted_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's token ids goes, in sequences of 1024; a null or empty text is its end id alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", packing)]

#: Removing byte strings, redacting and packing by a tokenizer can't be said in SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(settle(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
