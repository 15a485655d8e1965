"""A training-data pipeline of five stages over ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import exact_dedup, minhash_dedup, packing, quality, suffix_dedup
from larkspur.llm.queries import byte_bpe, table
from larkspur.llm.workspace import stage

TEMPERATURE = 0.25


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that importance resampling does not draw; a temperature below 1, as a filter should follow the weights more than the noise."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), temperature=TEMPERATURE)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return minhash_dedup.drop_near_duplicates(docs, shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 51 words or more, or of 400 bytes or more, that occur elsewhere."""
    return suffix_dedup.remove_repeats(docs, words=51)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, **byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed_sequences),
]

#: The classifier, the tokenizer and the packing have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
