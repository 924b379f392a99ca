"""Identifier inventories, term counts and replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identifiers as op
from . import relations as rel
from .classification import TOKENS
from .registry import register, with_ctes


@register("unit_identifiers", with_ctes(rel.UNITS_SQL, body=f"""
SELECT DISTINCT unit_id, unnest({TOKENS}) AS identifier FROM units"""))
def unit_identifiers(spark, sf_dir):
    return op.unit_identifiers(rel.units(spark, sf_dir))


@register("identifier_inventory", with_ctes(rel.UNITS_SQL, body=f"""
SELECT identifier, count(*) AS occurrences, count(DISTINCT unit_id) AS units
FROM (SELECT unit_id, unnest({TOKENS}) AS identifier FROM units) GROUP BY identifier"""))
def identifier_inventory(spark, sf_dir):
    return op.identifier_inventory(rel.units(spark, sf_dir))


@register("approx_identifier_count", with_ctes(rel.UNITS_SQL, body=f"""
SELECT kind, count(DISTINCT identifier) AS exact, true AS within_tolerance
FROM (SELECT kind, unnest({TOKENS}) AS identifier FROM units) GROUP BY kind"""))
def approx_identifier_count(spark, sf_dir):
    """The sketch against the exact count: within five standard errors of two percent."""
    units = rel.units(spark, sf_dir)
    exact = units.select("kind", F.explode(op.identifiers(F.col("code"))).alias("i")).groupBy(
        "kind").agg(F.count_distinct("i").alias("exact"))
    return op.approx_identifier_count(units).join(exact, "kind").select(
        "kind", "exact", (F.abs(F.col("identifiers") - F.col("exact")) <= 0.1 * F.col("exact") + 2)
        .alias("within_tolerance"))


# Terms with and without characters outside of words, one that never occurs.
TERMS = ("the", "de", "var", "function", "track", "a", "val", "$data", "data$", "obj.val", "a$b",
         "été", "p", "never_there", "x === void 0", "=> {")
TERM_ROWS_SQL = "terms(term) AS (VALUES " + ", ".join(f"({rel.sql_text(t)})" for t in TERMS) + ")"
COUNT_SQL = r"len(regexp_extract_all(code, '\b' || regexp_escape(term) || '\b'))"


@register("term_counts", with_ctes(rel.UNITS_SQL, TERM_ROWS_SQL, body=f"""
SELECT term, sum({COUNT_SQL})::BIGINT AS n FROM units, terms GROUP BY term"""))
def term_counts(spark, sf_dir):
    return op.count_terms(rel.units(spark, sf_dir), TERMS)


@register("unit_term_counts", with_ctes(rel.UNITS_SQL, TERM_ROWS_SQL, body=f"""
SELECT unit_id, term, sum({COUNT_SQL})::BIGINT AS n FROM units, terms GROUP BY unit_id, term"""))
def unit_term_counts(spark, sf_dir):
    return op.count_terms(rel.units(spark, sf_dir), TERMS, per_unit=True)


REPLACEMENTS = (("the", "THE"), ("val", "the"), ("data$", "$&1"), ("p", r"\1q"), ("THE", "Z$"))


def _replaced_sql() -> str:
    code = "code"
    for old, new in REPLACEMENTS:
        code = (rf"regexp_replace({code}, '\b' || regexp_escape({rel.sql_text(old)}) || '\b', "
                rf"replace({rel.sql_text(new)}, '\', '\\'), 'g')")
    return code


@register("replaced_terms", with_ctes(
    rel.UNITS_SQL, body=f"SELECT unit_id, {_replaced_sql()} AS code FROM units"))
def replaced_terms(spark, sf_dir):
    return op.replace_terms(rel.units(spark, sf_dir), REPLACEMENTS).select("unit_id", "code")
