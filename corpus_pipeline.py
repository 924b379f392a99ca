"""From raw documents to packed sequences: quality, near duplicates, repeats, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codecorpus.llm import minhash, packing, quality, repeats, tokens
from codecorpus.llm.tables import read_table, stored


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score is 0.3 or more."""
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the smallest doc_id."""
    return minhash.keep_first(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that stand in the kept documents more than once."""
    return repeats.cut_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' pieces, placed in sequences of at most 2048 tokens."""
    return packing.pack(tokens.pieces(docs, 2048), 2048, ("doc_id", "piece"))


STAGES = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_dedup),
    ("best_fit_packing", pack),
]
#: The stages are beyond SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
