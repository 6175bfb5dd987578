"""The corpus pipeline: documents to token ids in five stages, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept and returns the columns of documents, whatever they are called; the
last returns doc_id, n_tokens, ids and same_text alone. Null and empty texts have too few words for the first stage.
Rows with a null id are judged by their own text and link with nothing. Of rows that repeat both id and text one passes
the third stage; rows that repeat an id with other texts are documents of their own. Ties (equal texts of different ids)
go to the least id. Texts of any length are read whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, language_id, minhash_dedup, mixing, quality
from tessera.llm.common import stored, table

#: Texts whose language is less certain than this are rejected; one language surely ahead of the others has 0.5.
MIN_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the base rules or the isolation forest reject: texts of under 20 words, null ones among them, too.

    Without labels of both kinds the base rules decide alone.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose language is uncertain. Learns from the rows that have a lang;
    where there are none, nothing can be identified, and all rows go."""
    return language_id.keep_identified(docs, MIN_LANGUAGE_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8): the one of least id."""
    return minhash_dedup.keep_representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents to the sources' target weights and shuffles them; null is a source."""
    return mixing.mix_sources(docs).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gave the text again; other columns end here."""
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, check=True)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "same_text")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
#: Forests and kernels are beyond SQL; tests/llm compares run() with plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables; labels are read by the first."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
