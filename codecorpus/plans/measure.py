"""Statistics, features and version metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions.text import exact_mean
from ..operators import features as op
from . import relations as rel
from .registry import register, with_ctes

LINES = "(length(code) - length(replace(code, chr(10), '')) + 1)"
FUNCTIONS = r"""(len(regexp_extract_all(code, 'function\s+\w+'))
  + len(regexp_extract_all(code, '\w+\s*:\s*function')) + len(regexp_extract_all(code, '=>\s*\{')))"""
FUNCTIONS_FULL = rf"({FUNCTIONS} + len(regexp_extract_all(code, '\w+\s*=\s*function')))"
VARIABLES = r"len(regexp_extract_all(code, '\b(?:var|let|const)\s+\w+'))"
BRANCHES = r"len(regexp_extract_all(code, '\bif\b|\bwhile\b|\bfor\b|\bswitch\b'))"
SIZE_BAND = "CASE WHEN lines > 1000 THEN 3 WHEN lines > 500 THEN 2 WHEN lines > 100 THEN 1 ELSE 0 END"
FUNCTION_BAND = "CASE WHEN functions > 50 THEN 2 WHEN functions > 20 THEN 1 ELSE 0 END"
DEPTH_SQL = """
depths AS (
  SELECT unit_id, greatest(coalesce(max(d), 0), 0)::BIGINT AS depth FROM (
    SELECT unit_id, sum(CASE WHEN b = '{' THEN 1 WHEN b = '}' THEN -1 END)
                      OVER (PARTITION BY unit_id ORDER BY i) AS d
    FROM (SELECT unit_id, unnest(list_prepend('', regexp_extract_all(code, '[{}]'))) AS b,
                 generate_subscripts(list_prepend('', regexp_extract_all(code, '[{}]')), 1) AS i
          FROM units)) GROUP BY unit_id)"""

STATISTICS_SQL = f"""
statistics AS (
  SELECT *, ({SIZE_BAND} + {FUNCTION_BAND})::BIGINT AS complexity FROM (
    SELECT unit_id, kind, length(code) AS n_chars, {LINES} AS lines,
           ceil(length(code) / 4.0)::BIGINT AS tokens, {FUNCTIONS}::BIGINT AS functions,
           {VARIABLES}::BIGINT AS variables FROM units))"""


@register("unit_statistics", with_ctes(rel.UNITS_SQL, STATISTICS_SQL, body="SELECT * FROM statistics"))
def unit_statistics(spark, sf_dir):
    return op.unit_statistics(rel.units(spark, sf_dir))


@register("line_counts", with_ctes(rel.UNITS_SQL, body=f"SELECT unit_id, {LINES} AS lines FROM units"))
def line_counts(spark, sf_dir):
    return rel.units(spark, sf_dir).select("unit_id", ft.line_count(F.col("code")).alias("lines"))


@register("token_estimates", with_ctes(
    rel.UNITS_SQL,
    body="SELECT kind, sum(ceil(length(code) / 4.0))::BIGINT AS tokens, count(*) AS units FROM units GROUP BY kind"))
def token_estimates(spark, sf_dir):
    return rel.units(spark, sf_dir).groupBy("kind").agg(
        F.sum(ft.token_estimate(F.col("code"))).alias("tokens"),
        F.count(F.lit(1)).alias("units"))


@register("function_counts", with_ctes(rel.UNITS_SQL, body=f"""
SELECT unit_id, {FUNCTIONS}::BIGINT AS functions, {FUNCTIONS_FULL}::BIGINT AS functions_full FROM units"""))
def function_counts(spark, sf_dir):
    code = F.col("code")
    return rel.units(spark, sf_dir).select(
        "unit_id", ft.function_count(code).alias("functions"),
        ft.function_count_full(code).alias("functions_full"))


@register("variable_counts", with_ctes(
    rel.UNITS_SQL, body=f"SELECT unit_id, {VARIABLES}::BIGINT AS variables FROM units"))
def variable_counts(spark, sf_dir):
    return rel.units(spark, sf_dir).select(
        "unit_id", ft.variable_count(F.col("code")).alias("variables"))


@register("brace_depth", with_ctes(rel.UNITS_SQL, DEPTH_SQL, body="SELECT * FROM depths"))
def brace_depth(spark, sf_dir):
    return rel.units(spark, sf_dir).select(
        "unit_id", ft.brace_depth(F.col("code")).alias("depth"))


@register("complexity_bands", with_ctes(rel.UNITS_SQL, DEPTH_SQL, body=f"""
SELECT unit_id, lines, functions, function_words, depth, branches,
       ({SIZE_BAND} + {FUNCTION_BAND} + CASE WHEN depth > 10 THEN 2 WHEN depth > 5 THEN 1 ELSE 0 END)::BIGINT
         AS complexity,
       CASE WHEN lines > 1000 OR function_words > 50 THEN 'high'
            WHEN lines > 300 OR function_words > 15 THEN 'medium' ELSE 'low' END AS label,
       branches + depth AS cyclomatic
FROM (SELECT unit_id, {LINES} AS lines, {FUNCTIONS_FULL}::BIGINT AS functions,
             len(regexp_extract_all(code, 'function'))::BIGINT AS function_words,
             {BRANCHES}::BIGINT AS branches FROM units) JOIN depths USING (unit_id)"""))
def complexity_bands(spark, sf_dir):
    return op.structure_statistics(rel.units(spark, sf_dir))


@register("framework_tags", with_ctes(rel.UNITS_SQL, body="""
SELECT unit_id, array_to_string(list_filter([
    CASE WHEN contains(code, 'jQuery') OR contains(code, '$') THEN 'jquery' END,
    CASE WHEN contains(code, 'React') OR contains(code, 'jsx') THEN 'react' END,
    CASE WHEN contains(code, 'Vue') THEN 'vue' END,
    CASE WHEN contains(code, 'angular') THEN 'angular' END,
    CASE WHEN contains(code, 'webpack') THEN 'webpack' END], lambda t: t IS NOT NULL), ',') AS tags
FROM units"""))
def framework_tags(spark, sf_dir):
    return op.framework_tags(rel.units(spark, sf_dir)).withColumn(
        "tags", F.array_join("tags", ","))


REQUIRE = r"""'require\([''"`]([^''"`]+)[''"`]\)'"""
IMPORT = r"""'import[^\n\r]*from\s+[''"`]([^''"`]+)[''"`]'"""
DEPENDENCIES_SQL = f"""
dependencies AS (
  SELECT unit_id, unnest(s) AS statement, unnest(m) AS module, generate_subscripts(m, 1) - 1 AS ordinal
  FROM (SELECT unit_id,
               regexp_extract_all(code, {REQUIRE}) || regexp_extract_all(code, {IMPORT}) AS s,
               regexp_extract_all(code, {REQUIRE}, 1) || regexp_extract_all(code, {IMPORT}, 1) AS m
        FROM units))"""


@register("dependency_rows", with_ctes(
    rel.UNITS_SQL, DEPENDENCIES_SQL,
    body="SELECT unit_id, ordinal::BIGINT AS ordinal, statement, module FROM dependencies"))
def dependency_rows(spark, sf_dir):
    return op.dependency_rows(rel.units(spark, sf_dir))


@register("dependency_counts", with_ctes(rel.UNITS_SQL, DEPENDENCIES_SQL, body="""
SELECT module, count(*) AS statements, count(DISTINCT unit_id) AS units FROM dependencies GROUP BY module"""))
def dependency_counts(spark, sf_dir):
    return op.dependency_counts(rel.units(spark, sf_dir))


VERSIONS_SQL = """
versions AS (
  SELECT unit_id, u.code AS b, r.code AS a, length(u.code) AS nb, length(r.code) AS na,
         length(u.code) - length(replace(u.code, chr(10), '')) + 1 AS lb,
         length(r.code) - length(replace(r.code, chr(10), '')) + 1 AS la
  FROM units u JOIN reworked r USING (unit_id))"""


def _versions(spark, sf_dir, how):
    before = rel.units(spark, sf_dir)
    return op.compare_versions(before, rel.reworked(before), how)


@register("unpack_metrics", with_ctes(rel.UNITS_SQL, rel.REWORKED_SQL, VERSIONS_SQL, body="""
SELECT unit_id, lb AS original_lines, la AS processed_lines,
       floor((la - lb)::DOUBLE / lb * 100 + 0.5)::BIGINT AS line_increase,
       floor((nb - lb + 1)::DOUBLE / lb + 0.5)::BIGINT AS original_avg_line_length,
       floor((na - la + 1)::DOUBLE / la + 0.5)::BIGINT AS processed_avg_line_length,
       CASE WHEN nb > 0 THEN floor((na - nb)::DOUBLE / nb * 100 + 0.5)::BIGINT END AS size_increase
FROM versions"""))
def unpack_metrics(spark, sf_dir):
    return _versions(spark, sf_dir, "unpack")


@register("transform_metrics", with_ctes(rel.UNITS_SQL, rel.REWORKED_SQL, VERSIONS_SQL, body="""
SELECT unit_id, la - lb AS lines_added, abs(na - nb) AS characters_changed,
       CASE WHEN nb > 0 THEN na::DOUBLE / nb END AS transformation_ratio FROM versions"""))
def transform_metrics(spark, sf_dir):
    return _versions(spark, sf_dir, "transform")


@register("format_metrics", with_ctes(rel.UNITS_SQL, rel.REWORKED_SQL, VERSIONS_SQL, body="""
SELECT unit_id, lb AS original_lines, la AS formatted_lines, la - lb AS lines_difference,
       nb AS original_length, na AS formatted_length, na - nb AS length_difference,
       CASE WHEN nb > 0 THEN na::DOUBLE / nb ELSE 1.0::DOUBLE END AS compression_ratio FROM versions"""))
def format_metrics(spark, sf_dir):
    return _versions(spark, sf_dir, "format")


IDIOMS_SQL = r"""
idioms AS (
  SELECT unit_id, len(regexp_extract_all(code, '\bvoid 0\b')) AS void_zero,
         len(regexp_extract_all(code,
           '(?:\b(?:[0-9]+|null|true|false)|"[^"\n]*")\s*(?:===|!==|==|!=|<=|>=|<|>)\s*[A-Za-z_$]')) AS literal_first,
         len(regexp_extract_all(code, '\b[0-9]+(?:\.[0-9]+)?e[0-9]+\b')) AS exponent_literal,
         len(regexp_extract_all(code, '(?:^|[^!=<>])===?\s*(?:true|false)\b')) AS compare_boolean,
         len(regexp_extract_all(code, '!![A-Za-z_$(]')) AS double_negation
  FROM units)"""


@register("idiom_counts", with_ctes(rel.UNITS_SQL, IDIOMS_SQL, body="SELECT * FROM idioms"))
def idiom_counts(spark, sf_dir):
    return op.idiom_counts(rel.units(spark, sf_dir))


@register("idiom_prevalence", with_ctes(rel.UNITS_SQL, IDIOMS_SQL, body="""
SELECT idiom, sum(n)::BIGINT AS occurrences, count(*) FILTER (WHERE n > 0) AS units
FROM (UNPIVOT idioms ON void_zero, literal_first, exponent_literal, compare_boolean, double_negation
      INTO NAME idiom VALUE n) GROUP BY idiom"""))
def idiom_prevalence(spark, sf_dir):
    return op.idiom_prevalence(rel.units(spark, sf_dir))


@register("corpus_overview", with_ctes(rel.UNITS_SQL, DEPTH_SQL, body=f"""
SELECT kind, count(*) AS units, sum({LINES})::BIGINT AS lines,
       sum(ceil(length(code) / 4.0))::BIGINT AS tokens, max(depth) AS max_depth,
       sum((share)::DECIMAL(18,6))::DOUBLE / count(share) AS short_name_share
FROM (SELECT *, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: length(x) = 1))::DOUBLE / len(t) END AS share
      FROM (SELECT *, regexp_extract_all(code, '\\b[a-zA-Z_$][a-zA-Z0-9_$]*\\b') AS t FROM units))
JOIN depths USING (unit_id) GROUP BY kind"""))
def corpus_overview(spark, sf_dir):
    """Per kind of unit: size, nesting and the mean share of one-letter names."""
    from ..functions.classify import short_name_share
    from ..functions.text import identifiers
    code = F.col("code")
    facts = rel.units(spark, sf_dir).select(
        "kind", ft.line_count(code).alias("lines"), ft.token_estimate(code).alias("tokens"),
        ft.brace_depth(code).alias("depth"), identifiers(code).alias("t"),
    ).select("kind", "lines", "tokens", "depth", short_name_share(F.col("t")).alias("share"))
    return facts.groupBy("kind").agg(
        F.count(F.lit(1)).alias("units"), F.sum("lines").alias("lines"),
        F.sum("tokens").alias("tokens"), F.max("depth").alias("max_depth"),
        exact_mean(F.col("share").cast("decimal(18,6)")).alias("short_name_share"))
