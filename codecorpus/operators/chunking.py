"""Cutting units into chunks and putting chunk outputs together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunks as ch
from .rows import explode_once


def explode_chunks(units: DataFrame, chunk_array: Column) -> DataFrame:
    """One row per chunk. The rows carry the chunk, not the text it was cut from."""
    rows = explode_once(
        units, "unit_id", array=chunk_array, name="c", position="chunk_index")
    return rows.select("unit_id", "chunk_index", "c.start", "c.end", "c.text")


def overlap_chunks(
    units: DataFrame, size: int = ch.DEFAULT_SIZE, overlap: int | None = None
) -> DataFrame:
    """Overlapping chunks cut at statement ends; a unit that fits is one chunk."""
    return explode_chunks(units, ch.overlap_chunks(F.col("code"), size, overlap))


def boundary_chunks(units: DataFrame, size: int = ch.STREAM_SIZE) -> DataFrame:
    """Consecutive chunks cut at statement ends."""
    return explode_chunks(units, ch.boundary_chunks(F.col("code"), size))


def fixed_chunks(units: DataFrame, size: int = ch.STREAM_SIZE) -> DataFrame:
    """Consecutive chunks of exactly `size` characters."""
    return explode_chunks(units, ch.fixed_chunks(F.col("code"), size))


def token_chunks(units: DataFrame, max_tokens: int = ch.MAX_TOKENS, **shares: float) -> DataFrame:
    """Overlapping chunks of a token budget."""
    return explode_chunks(units, ch.token_chunks(F.col("code"), max_tokens, **shares))


def reassemble(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Texts of consecutive chunks joined in order; a group is no larger than its unit."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", F.col(text).alias("t"))))
    return chunks.groupBy("unit_id").agg(
        F.array_join(F.transform(ordered, lambda c: c.t), "").alias("code"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
