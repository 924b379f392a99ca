"""Classifiers, filters and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions.text import count_char, identifiers
from ..operators import classify as op
from ..operators import renames as rn
from . import relations as rel
from .measure import BRANCHES, DEPTH_SQL
from .registry import register, with_ctes

TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"
TOKENS = r"regexp_extract_all(code, '\b[a-zA-Z_$][a-zA-Z0-9_$]*\b')"
INDICATORS_SQL = rf"""
facts AS (
  SELECT unit_id, code, {TOKENS} AS t, string_split(code, chr(10)) AS l,
         length(code) - length(replace(code, ';', '')) AS semis,
         length(code) - length(replace(code, chr(10), '')) AS breaks FROM units),
indicators AS (
  SELECT unit_id,
    list_sum(list_transform(l, lambda x: length(trim(x, {TRIM}))))::DOUBLE / len(l) > 200 AS long_lines,
    len(t) > 0 AND len(list_filter(t, lambda x: length(x) = 1))::DOUBLE / greatest(len(t), 1) > 0.3
      AS single_letter_vars,
    regexp_matches(code, '(?i)\\x[0-9a-f]{{2}}|\\u[0-9a-f]{{4}}') AS has_encoding,
    regexp_matches(code, 'eval\s*\(') AS has_eval,
    regexp_matches(code, '["''][^"'']*["'']\s*\+\s*["''][^"'']*["'']') AS has_string_concat,
    semis > 10 AND breaks > 0 AND semis::DOUBLE / greatest(breaks, 1) > 5 AS minified_structure
  FROM facts)"""


@register("obfuscation_indicators", with_ctes(rel.UNITS_SQL, INDICATORS_SQL, body="""
SELECT *, array_to_string(list_filter([
    CASE WHEN long_lines THEN 'long_lines' END,
    CASE WHEN single_letter_vars THEN 'single_letter_vars' END,
    CASE WHEN has_encoding THEN 'has_encoding' END, CASE WHEN has_eval THEN 'has_eval' END,
    CASE WHEN has_string_concat THEN 'has_string_concat' END,
    CASE WHEN minified_structure THEN 'minified_structure' END], lambda x: x IS NOT NULL), ',') AS active,
  n AS n_indicators, n >= 2 AS needs_processing
FROM (SELECT *, long_lines::BIGINT + single_letter_vars::BIGINT + has_encoding::BIGINT
        + has_eval::BIGINT + has_string_concat::BIGINT + minified_structure::BIGINT AS n FROM indicators)
""".replace("SELECT *, array", "SELECT * EXCLUDE (n), array")))
def obfuscation_indicators(spark, sf_dir):
    return op.obfuscation_indicators(rel.units(spark, sf_dir)).drop("path", "kind", "code").withColumn(
        "active", F.array_join("active", ","))


@register("units_to_process", with_ctes(rel.UNITS_SQL, INDICATORS_SQL, body="""
SELECT kind, count(*) AS units FROM indicators JOIN units USING (unit_id)
WHERE long_lines::INT + single_letter_vars::INT + has_encoding::INT
      + has_eval::INT + has_string_concat::INT + minified_structure::INT >= 2 GROUP BY kind"""))
def units_to_process(spark, sf_dir):
    todo, _ = op.split_readable(rel.units(spark, sf_dir))
    return todo.groupBy("kind").agg(F.count(F.lit(1)).alias("units"))


@register("short_name_share", with_ctes(rel.UNITS_SQL, body=rf"""
SELECT unit_id, len(t) AS names, CASE WHEN len(t) > 0
  THEN len(list_filter(t, lambda x: length(x) = 1))::DOUBLE / len(t) END AS share
FROM (SELECT unit_id, {TOKENS} AS t FROM units)"""))
def short_name_share(spark, sf_dir):
    toks = rel.units(spark, sf_dir).select("unit_id", identifiers(F.col("code")).alias("t"))
    return toks.select(
        "unit_id", F.size("t").cast("long").alias("names"),
        cl.short_name_share(F.col("t")).alias("share"))


@register("line_break_density", with_ctes(rel.UNITS_SQL, INDICATORS_SQL, body="""
SELECT unit_id, semis AS n_semicolons, breaks AS n_newlines, minified_structure AS few_breaks
FROM facts JOIN indicators USING (unit_id)"""))
def line_break_density(spark, sf_dir):
    code = F.col("code")
    return rel.units(spark, sf_dir).select(
        "unit_id", count_char(code, ";").alias("n_semicolons"),
        count_char(code, "\n").alias("n_newlines"), cl.has_few_line_breaks(code).alias("few_breaks"))


@register("mean_line_length", with_ctes(rel.UNITS_SQL, INDICATORS_SQL, body=f"""
SELECT unit_id, list_sum(list_transform(l, lambda x: length(trim(x, {TRIM}))))::DOUBLE / len(l) AS mean_length
FROM facts"""))
def mean_line_length(spark, sf_dir):
    return rel.units(spark, sf_dir).select(
        "unit_id", cl.mean_trimmed_line_length(F.col("code")).alias("mean_length"))


@register("escape_eval_concat", with_ctes(
    rel.UNITS_SQL, INDICATORS_SQL,
    body="SELECT unit_id, has_encoding, has_eval, has_string_concat FROM indicators"))
def escape_eval_concat(spark, sf_dir):
    code = F.col("code")
    return rel.units(spark, sf_dir).select(
        "unit_id", cl.has_escapes(code).alias("has_encoding"), cl.has_eval(code).alias("has_eval"),
        cl.has_literal_concat(code).alias("has_string_concat"))


@register("oversize_units", with_ctes(rel.UNITS_SQL, body="""
SELECT unit_id, 'WEBCRACK_FAILED' AS code,
       'Input code too large: ' || floor(length(code) / 1048576.0 + 0.5)::BIGINT || 'MB (max: 0MB)' AS message,
       'webcrack' AS step, true AS recoverable
FROM units WHERE length(code) > 20000"""))
def oversize_units(spark, sf_dir):
    return op.split_oversize(rel.units(spark, sf_dir), 20_000)[1]


TYPED_SQL = r"""(regexp_matches(code, ':\s*\w+(\[\])?(\s*\|\s*\w+)*\s*[=;,)]')
  OR regexp_matches(code, 'interface\s+\w+') OR regexp_matches(code, 'type\s+\w+\s*=')
  OR regexp_matches(code, 'enum\s+\w+') OR regexp_matches(code, '<\w+>')
  OR regexp_matches(code, '\w+\?\s*:') OR regexp_matches(code, 'public\s+|private\s+|protected\s+'))"""
MARKUP_SQL = rf"""(regexp_matches(code, '(<\w+[^>]*>|</\w+>)')
  AND NOT regexp_matches(trim(code, {TRIM}), '^\s*<!--'))"""


@register("dialect_detection", with_ctes(rel.UNITS_SQL, body=f"""
SELECT unit_id, path,
  CASE WHEN ext IN ('ts', 'tsx') THEN 'typescript' WHEN ext = 'jsx' THEN 'babel'
       WHEN typed THEN 'typescript' ELSE 'babel' END AS dialect,
  CASE WHEN ext IN ('ts', 'tsx', 'jsx') THEN 'extension' WHEN typed THEN 'typed_syntax'
       WHEN markup THEN 'markup_syntax' ELSE 'default' END AS rule
FROM (SELECT unit_id, path, lower(list_last(string_split(path, '.'))) AS ext,
             {TYPED_SQL} AS typed, {MARKUP_SQL} AS markup FROM units)"""))
def dialect_detection(spark, sf_dir):
    return op.detect_dialect(rel.units(spark, sf_dir))


@register("confident_suggestions", with_ctes(rel.SUGGESTIONS_SQL, body="""
SELECT unit_id, count(*) AS kept FROM suggestions WHERE confidence >= 0.3 GROUP BY unit_id"""))
def confident_suggestions(spark, sf_dir):
    return op.filter_confident(rel.suggestions(spark, sf_dir)).groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("kept"))


BAD_ESCAPES = r"""len(list_filter(regexp_extract_all(code, '\\[a-zA-Z][a-zA-Z0-9_]+'),
  lambda m: NOT regexp_full_match(m, '\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4})')))"""


@register("bad_escapes", with_ctes(
    rel.UNITS_SQL, body=f"SELECT unit_id, {BAD_ESCAPES} > 0 AS bad_escape FROM units"))
def bad_escapes(spark, sf_dir):
    return rn.flag_bad_escapes(rel.units(spark, sf_dir))


RESERVED_SQL = ", ".join(rel.sql_text(w) for w in cl.RESERVED)


@register("reserved_targets", with_ctes(rel.SCRIPTS_SQL, rel.RENAMES_SQL, body=f"""
SELECT unit_id, ordinal, original_name,
       CASE WHEN suggested_name IN ({RESERVED_SQL}) THEN suggested_name || '$' ELSE suggested_name END
         AS suggested_name FROM renames"""))
def reserved_targets(spark, sf_dir):
    return rn.guard_targets(rel.renames(spark, sf_dir)).select(
        "unit_id", "ordinal", "original_name", "suggested_name")


@register("cosmetic_changes", with_ctes(rel.UNITS_SQL, rel.REWORKED_SQL, body=rf"""
SELECT unit_id, u.code = r.code AS identical,
       trim(regexp_replace(u.code, '\s+', ' ', 'g'), {TRIM}) = trim(regexp_replace(r.code, '\s+', ' ', 'g'), {TRIM})
         AS cosmetic_only
FROM units u JOIN reworked r USING (unit_id)"""))
def cosmetic_changes(spark, sf_dir):
    before = rel.units(spark, sf_dir)
    return op.cosmetic_changes(before, rel.reworked(before))


@register("error_retry_classes", with_ctes(rel.RUN_LOG_SQL, body="""
SELECT unit_id, status, message,
       regexp_matches(lower(message), 'unauthorized|invalid api key|forbidden|quota|billing|insufficient funds|invalid input|malformed|bad request') AS non_retryable,
       status = 429 OR status >= 500 OR regexp_matches(lower(message), 'timeout|connection') AS retryable
FROM run_log WHERE NOT ok"""))
def error_retry_classes(spark, sf_dir):
    failed = rel.run_log(spark, sf_dir).filter(~F.col("ok")).select("unit_id", "status", "message")
    return op.classify_errors(failed)


OFFERED_SQL = " OR ".join(
    f"(provider = {rel.sql_text(p)} AND model IN ({', '.join(rel.sql_text(m) for m in ms)}))"
    for p, ms in cl.OFFERED_MODELS.items())


@register("settings_validation", with_ctes(rel.SETTINGS_SQL, body=f"""
SELECT setting_id, array_to_string(e, '; ') AS errors, array_to_string(w, '; ') AS warnings, len(e) = 0 AS valid
FROM (SELECT setting_id, list_filter([
    CASE WHEN provider NOT IN ('anthropic', 'openai', 'azure', 'ollama')
         THEN 'Unsupported provider: ' || provider END,
    CASE WHEN provider IN ('anthropic', 'openai', 'azure', 'ollama') AND NOT ({OFFERED_SQL})
         THEN 'Model ''' || model || ''' not available for ' || provider END,
    CASE WHEN provider IN ('anthropic', 'openai', 'azure') AND api_key IS NULL
         THEN 'API key required for ' || provider END,
    CASE WHEN provider = 'azure' AND base_url IS NULL THEN '{cl.MSG_AZURE_URL}' END,
    CASE WHEN temperature < 0 OR temperature > 2 THEN '{cl.MSG_TEMPERATURE}' END,
    CASE WHEN max_tokens < 1 OR max_tokens > 200000 THEN '{cl.MSG_MAX_TOKENS}' END],
    lambda x: x IS NOT NULL) AS e, list_filter([
    CASE WHEN provider = 'ollama' AND base_url IS NULL THEN '{cl.WARN_OLLAMA_URL}' END,
    CASE WHEN temperature > 1.0 THEN '{cl.WARN_TEMPERATURE}' END,
    CASE WHEN max_tokens > 100000 THEN '{cl.WARN_MAX_TOKENS}' END], lambda x: x IS NOT NULL) AS w
  FROM settings)"""))
def settings_validation(spark, sf_dir):
    checked = op.validate_settings(rel.settings(spark, sf_dir))
    return checked.select(
        "setting_id", F.array_join("errors", "; ").alias("errors"),
        F.array_join("warnings", "; ").alias("warnings"), "valid")


@register("workload_classes", with_ctes(rel.UNITS_SQL, DEPTH_SQL, body=f"""
SELECT unit_id, size,
  CASE WHEN size > 100000 THEN 'chunking' ELSE 'preprocessing' END AS strategy,
  CASE WHEN size > 100000 THEN 'chunks' WHEN complexity > 50 THEN 'conditionals'
       WHEN react THEN 'react' ELSE 'cleanup' END AS profile,
  CASE WHEN size > 100000 THEN least(50000, floor(size / 4.0))::BIGINT END AS chunk_size,
  CASE WHEN size > 100000 THEN 1000::BIGINT END AS overlap,
  CASE WHEN size > 100000 THEN 'Large file size detected'
       WHEN complexity > 50 THEN 'High code complexity detected'
       WHEN react THEN 'React framework detected' ELSE 'Default optimizations' END AS reason
FROM (SELECT unit_id, length(code) AS size, {BRANCHES} + depth AS complexity,
             contains(code, 'React') OR contains(code, 'jsx') AS react FROM units JOIN depths USING (unit_id))"""))
def workload_classes(spark, sf_dir):
    return op.workload_classes(rel.units(spark, sf_dir))
