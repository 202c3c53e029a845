"""From documents to packed token sequences, in five stages. Part of the optional training-data operators.

Every stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm import hosts, lines, neardup, packing, passages
from resight.llm.common import WORD_PATTERN
from resight.session import cut


def with_lengths(docs: DataFrame) -> DataFrame:
    """`n_chars` of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def with_words(docs: DataFrame) -> DataFrame:
    """Documents that still have a word; every one had when it passed the quality rules."""
    return docs.where(F.col("text").rlike(WORD_PATTERN))


#: Bytes of a repeated passage: 51 words are seldom under 250 bytes, and hardly ever under 200.
PASSAGE = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or come from a host most of whose documents fail, go."""
    return hosts.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are nearly the same the first stays; documents go that consist of later ones only."""
    return with_lengths(with_words(lines.drop_lines(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.keep_one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of `PASSAGE` that stand anywhere else go; documents go that consist of them only."""
    return with_lengths(with_words(passages.cut_repeats(docs, passages.PassageParams(width=PASSAGE))))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024."""
    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicate documents", near_dedup),
    ("repeated passages", passage_dedup),
    ("packing", packed_sequences),
]

#: Shingle components, suffix arrays and tokenizers are beyond SQL; the tests hold what each stage returns against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
