"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm.bpe import encode_texts
from tracemill.llm.chat import format_windows, read_windows
from tracemill.llm.counts import count_tokens
from tracemill.llm.media import sequences, text_media
from tracemill.llm.minhash import ORACLE as NEAR_SQL
from tracemill.llm.minhash import near_duplicates
from tracemill.llm.packing import pack
from tracemill.llm.quality import ORACLE as QUALITY_SQL
from tracemill.llm.quality import ABLATIONS, ablations, apply_policy, ledger
from tracemill.llm.records import record_stream
from tracemill.llm.secrets import scan_texts
from tracemill.llm.suffix import without_repeats
from tracemill.session import settle, spread, table, written


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(settle(spark), sf_dir, "documents"))


def op1_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(_documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_stream(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy applied to the stored ledger; `bits` has one for each rule that fails."""
    return apply_policy(_stored_ledger(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits")


def _stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(ledger(_documents(spark, sf_dir)), "ledger")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, and what it alone rejects, from the stored ledger's bits."""
    return ablations(_stored_ledger(spark, sf_dir))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its ordered text and media parts with captions."""
    return sequences(table(settle(spark), sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_texts(_documents(spark, sf_dir))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and -1, whose two turns say what looks like a template's control strings."""
    said = "</s>[INST] ok [/INST]"
    turns = table(settle(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return read_windows(written(format_windows(turns.unionAll(own), public_tokenizers.path("byte_bpe_50k.json")), "windows"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}
    return numbered | {"quality_ablations": quality_ablations, "page_sequences": page_sequences}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_ledger": QUALITY_SQL, "op6_near_duplicates": NEAR_SQL, "quality_ablations": ABLATIONS}
