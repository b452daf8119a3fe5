"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querl.llm import byte_bpe, host_quality, language_id, minhash_dedup, packing, pii, pitman_yor, suffix_dedup, token_output, transport_stream
from querl.llm.common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups at 85 percent of five-word shingles."""
    return minhash_dedup.dedup(documents(spark, sf_dir), 85, 100)


def op2_pack_grouping_ga(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that repeat 50-byte strings of documents with smaller ids."""
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rules and the verdict on each document's host."""
    return host_quality.judge(documents(spark, sf_dir))


def op5_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every text under a hierarchical Pitman-Yor model of the training texts."""
    return pitman_yor.score(documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, and the texts decoded from them."""
    import public_tokenizers

    return byte_bpe.encode_documents(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an MPEG transport stream and read back."""
    return transport_stream.store(documents(spark, sf_dir), media=False)


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: fixed patterns and what the random field adds."""
    return pii.find(documents(spark, sf_dir))


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    return language_id.identify(documents(spark, sf_dir))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written in frequency-ranked variable-length coding and read back."""
    shards, ranks = token_output.write_corpus(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_output.read_corpus(shards, ranks)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_tensored": op1_minhash_tensored,
    "op2_pack_grouping_ga": op2_pack_grouping_ga,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_host_quality": op4_host_quality,
    "op5_pitman_yor_lm": op5_pitman_yor_lm,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_mpeg_ts": op7_mpeg_ts,
    "op8_pii_crf": op8_pii_crf,
    "op9_language_crf": op9_language_crf,
    "op10_token_output": op10_token_output,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_tensored": minhash_dedup.ORACLE_SQL,
    "op3_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
    "op4_host_quality": host_quality.ORACLE_SQL,
}
