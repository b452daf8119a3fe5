"""A corpus pipeline of five stages, each an operator of querl.llm over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents
(doc_id, text, lang, source, n_chars); the last returns the packed pieces.

Defined results: an empty table stays empty through all stages. The first stage drops null texts and
those without a letter. Rows that repeat a doc_id with one text become one in the second; a null doc_id
is near no other and stays, and may hold passages first in the third. Texts of any length are handled
whole. Columns other than those of documents are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querl.llm import language_id, minhash_dedup, packing, pii, suffix_dedup
from querl.llm.common import cut, documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("lang", "source")


def _columns(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.col(text).alias("text"), *REST, F.char_length(text).cast("long").alias("n_chars"))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified; those that are ``und`` (no letter) go.

    Where nothing can be learned, as no text has a lang, only texts without a letter go.
    """
    model = language_id.fit(docs)
    if not model.names:
        return docs.select(*COLUMNS).where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.predict(docs, model, carry=("text", *REST, "n_chars"))
    return found.where("lang_pred <> 'und'").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (80 percent of five-word shingles) stays: the one of the smallest doc_id."""
    kept = minhash_dedup.dedup(docs, 80, 100).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    known = docs.join(cut(kept, "kept-ids"), "doc_id")
    once = known.where("rows = 1")
    repeated = known.where("rows > 1").dropDuplicates(["doc_id", "text"])  # rows of one doc_id only: few, as a rule
    return once.union(repeated).select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 bytes or more that documents of smaller ids have; every document stays."""
    return _columns(suffix_dedup.dedup(docs, with_text=True, carry=REST), "kept_text")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by their kinds."""
    return _columns(pii.find(docs, texts=True, carry=REST), "clean_text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokenized documents into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's rows are written and read again."""
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
