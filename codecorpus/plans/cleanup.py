"""Text normalisation and preprocessing."""

from __future__ import annotations


from ..operators import normalize as op
from . import relations as rel
from .classification import TRIM
from .measure import BRANCHES, DEPTH_SQL
from .registry import register, with_ctes

NORMALISED = rf"trim(regexp_replace(regexp_replace(code, '\s+', ' ', 'g'), ';\s*;', ';', 'g'), {TRIM})"
FOLDED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(code,
    'if\s*\(\s*true\s*\)\s*\{([^}]*)\}', '\1', 'g'), 'if\s*\(\s*false\s*\)\s*\{[^}]*\}', '', 'g'),
    '\?\s*true\s*:\s*false', '', 'g'), '\?\s*false\s*:\s*true', '!', 'g')"""


@register("normalized_whitespace", with_ctes(
    rel.UNITS_SQL, body=f"SELECT unit_id, {NORMALISED} AS code FROM units"))
def normalized_whitespace(spark, sf_dir):
    return op.normalize_whitespace(rel.units(spark, sf_dir)).select("unit_id", "code")


@register("whitespace_fingerprint", with_ctes(
    rel.UNITS_SQL, body=f"SELECT unit_id, sha256({NORMALISED}) AS fingerprint FROM units"))
def whitespace_fingerprint(spark, sf_dir):
    return op.whitespace_fingerprint(rel.units(spark, sf_dir))


@register("folded_conditionals", with_ctes(
    rel.UNITS_SQL, body=f"SELECT unit_id, {FOLDED} AS code FROM units"))
def folded_conditionals(spark, sf_dir):
    return op.fold_conditionals(rel.units(spark, sf_dir)).select("unit_id", "code")


@register("kept_return_lines", with_ctes(rel.UNITS_SQL, body="SELECT unit_id, code FROM units"))
def kept_return_lines(spark, sf_dir):
    return op.keep_return_line(rel.units(spark, sf_dir)).select("unit_id", "code")


@register("dropped_after_return", with_ctes(rel.UNITS_SQL, body=r"""
SELECT unit_id, regexp_replace(code, '(return(?:[ \t(][^;{}\n]*)?;)[^{}]*\}', '\1}', 'g') AS code FROM units"""))
def dropped_after_return(spark, sf_dir):
    return op.drop_after_return(rel.units(spark, sf_dir)).select("unit_id", "code")


@register("preprocessed_units", with_ctes(rel.UNITS_SQL, DEPTH_SQL, body=f"""
SELECT unit_id, profile, CASE profile WHEN 'cleanup' THEN {NORMALISED} WHEN 'chunks' THEN {NORMALISED} WHEN 'conditionals' THEN {FOLDED}
                                      ELSE code END AS code
FROM (SELECT unit_id, code, CASE WHEN length(code) > 100000 THEN 'chunks'
               WHEN {BRANCHES} + depth > 50 THEN 'conditionals'
               WHEN contains(code, 'React') OR contains(code, 'jsx') THEN 'react' ELSE 'cleanup' END AS profile
      FROM units JOIN depths USING (unit_id))"""))
def preprocessed_units(spark, sf_dir):
    return op.preprocess(rel.units(spark, sf_dir))
