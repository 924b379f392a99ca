"""Chunking and reassembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunks as ch
from ..operators import chunking as op
from . import relations as rel
from .registry import register, with_ctes


def _last_boundary(window: str) -> str:
    """1-based position of the first boundary in the reversed window, 0 without one."""
    return (rf"(CASE WHEN regexp_matches({window}, '[\n;}})]') THEN "
            rf"length(regexp_extract(reverse({window}), '^[^\n;}})]*')) + 1 ELSE 0 END)")


def _overlap_sql(size: int, overlap: int) -> str:
    keep = size * 4 // 5

    def end(p: str) -> str:
        r = _last_boundary(f"substring(code, {p} + {keep + 2}, {size - keep})")
        return (f"CASE WHEN {p} + {size} >= length(code) THEN length(code) "
                f"WHEN {r} > 0 THEN {p} + {size + 2} - {r} ELSE {p} + {size} END")

    return f"""
cuts AS (
  SELECT unit_id, code, 0::BIGINT AS chunk_index, 0::BIGINT AS s, ({end('0')})::BIGINT AS e FROM units
  UNION ALL
  SELECT unit_id, code, chunk_index + 1, e - {overlap}, ({end(f'(e - {overlap})')})::BIGINT FROM cuts
  WHERE e < length(code))"""


def _boundary_sql(size: int) -> str:
    keep = -(-size * 4 // 5)

    def end(p: str) -> str:
        r = _last_boundary(f"substring(code, {p} + {keep + 1}, {size - keep})")
        return (f"CASE WHEN {p} + {size} > length(code) THEN length(code) "
                f"WHEN {r} > 0 THEN {p} + {size + 1} - {r} ELSE {p} + {size} END")

    return f"""
cuts AS (
  SELECT unit_id, code, 0::BIGINT AS chunk_index, 0::BIGINT AS s, ({end('0')})::BIGINT AS e
  FROM units
  UNION ALL
  SELECT unit_id, code, chunk_index + 1, e, ({end('e')})::BIGINT FROM cuts WHERE e < length(code))"""


CUTS_BODY = """SELECT unit_id, chunk_index, s AS start, e AS "end", substring(code, s + 1, e - s) AS text FROM cuts"""


@register("overlap_chunks", with_ctes(rel.UNITS_SQL, _overlap_sql(1000, 100), body=CUTS_BODY))
def overlap_chunks(spark, sf_dir):
    return op.overlap_chunks(rel.units(spark, sf_dir), 1000, 100)


@register("boundary_chunks", with_ctes(rel.UNITS_SQL, _boundary_sql(1000), body=CUTS_BODY))
def boundary_chunks(spark, sf_dir):
    return op.boundary_chunks(rel.units(spark, sf_dir), 1000)


@register("fixed_chunks", with_ctes(rel.UNITS_SQL, body="""
SELECT unit_id, s // 1500 AS chunk_index, s AS start, least(s + 1500, length(code)) AS "end",
       substring(code, s + 1, 1500) AS text
FROM (SELECT unit_id, code, unnest(range(0, greatest(length(code), 1), 1500)) AS s FROM units)"""))
def fixed_chunks(spark, sf_dir):
    return op.fixed_chunks(rel.units(spark, sf_dir), 1500)


@register("token_chunks", with_ctes(rel.UNITS_SQL, body="""
SELECT unit_id, s // 1280 AS chunk_index, s AS start, least(s + 1600, length(code)) AS "end",
       substring(code, s + 1, 1600) AS text
FROM (SELECT unit_id, code, unnest(range(0, greatest(length(code), 1), 1280)) AS s FROM units)
WHERE s = 0 OR s + 320 < length(code)"""))
def token_chunks(spark, sf_dir):
    return op.token_chunks(rel.units(spark, sf_dir), 1600)


@register("chunk_counts", with_ctes(rel.UNITS_SQL, _overlap_sql(4000, 400), body="""
SELECT unit_id, count(*) AS n_chunks, bool_and(s = 0 AND e = length(code)) AS whole FROM cuts GROUP BY unit_id"""))
def chunk_counts(spark, sf_dir):
    """Chunks per unit at the default size; short units are one whole chunk."""
    cut = rel.units(spark, sf_dir).select(
        "unit_id", F.length("code").alias("n"), ch.overlap_chunks(F.col("code")).alias("c"))
    return cut.select(
        "unit_id", F.size("c").cast("long").alias("n_chunks"),
        ((F.size("c") == 1) & (F.get("c", 0)["end"] == F.col("n"))).alias("whole"))


@register("reassembled_text", with_ctes(rel.UNITS_SQL, body="""
SELECT unit_id, replace(code, 'e', 'E') AS code, greatest(ceil(length(code) / 1500.0), 1)::BIGINT AS n_chunks
FROM units"""))
def reassembled_text(spark, sf_dir):
    done = op.fixed_chunks(rel.units(spark, sf_dir), 1500).withColumn(
        "text", F.replace("text", F.lit("e"), F.lit("E")))
    return op.reassemble(done)
