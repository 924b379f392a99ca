"""Parsing, consolidating and applying renames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import renames as op
from . import relations as rel
from .classification import BAD_ESCAPES, RESERVED_SQL
from .registry import register, with_ctes

# The JSON of an answer, and its list. DuckDB lets a comma stand before a closing bracket,
# which is not JSON.
ANSWER_SQL = r"""
tries AS (
  SELECT request_id, payload,
         CASE WHEN json_valid(payload) AND NOT regexp_matches(payload, ',\s*[\]}]')
              THEN payload::JSON END AS whole,
         regexp_extract(payload, '(?s)\[.*\]') AS a, regexp_extract(payload, '(?s)\{.*\}') AS o,
         instr(payload, '[') AS pa, instr(payload, '{') AS po
  FROM responses),
answers AS (
  SELECT request_id, payload, CASE
      WHEN whole IS NOT NULL AND json_type(whole) IN ('ARRAY', 'OBJECT') THEN whole
      WHEN pa > 0 AND (po = 0 OR pa < po) AND json_valid(a)
           AND NOT regexp_matches(a, ',\s*[\]}]') THEN a::JSON
      WHEN json_valid(o) AND NOT regexp_matches(o, ',\s*[\]}]') THEN o::JSON END AS answer
  FROM tries),
lists AS (
  SELECT request_id, answer, payload, CASE
      WHEN json_type(answer) = 'ARRAY' THEN json_extract(answer, '$[*]')
      WHEN json_type(answer, '$.suggestions') = 'ARRAY' THEN json_extract(answer, '$.suggestions[*]')
      WHEN json_type(answer, '$.renames') = 'ARRAY' THEN json_extract(answer, '$.renames[*]')
      WHEN json_type(answer, '$.variablesAndFunctionsToRename') = 'ARRAY'
        THEN json_extract(answer, '$.variablesAndFunctionsToRename[*]') END AS items
  FROM answers)"""


def _truthy(*fields: str) -> str:
    parts = [
        f"""CASE WHEN json_type(item, '$.{f}') IS NULL OR json_type(item, '$.{f}') = 'NULL' THEN NULL
             WHEN json_type(item, '$.{f}') = 'VARCHAR' AND item->>'$.{f}' = '' THEN NULL
             WHEN json_type(item, '$.{f}') = 'BOOLEAN' AND item->>'$.{f}' = 'false' THEN NULL
             WHEN json_type(item, '$.{f}') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
               AND (item->>'$.{f}')::DOUBLE = 0 THEN NULL
             ELSE json_extract(item, '$.{f}') END""" for f in fields]
    return f"coalesce({', '.join(parts)})"


def _string(v: str) -> str:
    return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN {v}->>'$' END"


PARSED_SQL = f"""
items AS (
  SELECT request_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS ordinal FROM lists),
fields AS (
  SELECT request_id, ordinal, json_type(item) = 'OBJECT' AS is_object,
         {_truthy('name', 'originalName', 'from')} AS o, {_truthy('newName', 'suggestedName', 'to')} AS s,
         {_truthy('reasoning', 'reason')} AS r, lower(item->>'$.type') AS t,
         CASE WHEN json_type(item, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
                AND (item->>'$.confidence')::DOUBLE BETWEEN 0 AND 1
              THEN (item->>'$.confidence')::DOUBLE ELSE 0.5 END AS confidence
  FROM items),
checked AS (
  SELECT *, CASE WHEN NOT is_object THEN 'Invalid suggestion at index ' || ordinal
      WHEN {_string('o')} IS NULL THEN 'Invalid originalName: expected non-empty string'
      WHEN {_string('s')} IS NULL THEN 'Invalid suggestedName: expected non-empty string'
      WHEN r IS NOT NULL AND {_string('r')} IS NULL THEN 'Invalid reasoning: expected text' END AS error
  FROM fields),
parsed AS (
  SELECT request_id, ordinal::BIGINT AS ordinal,
         CASE WHEN error IS NULL THEN {_string('o')} END AS original_name,
         CASE WHEN error IS NULL THEN {_string('s')} END AS suggested_name,
         CASE WHEN error IS NULL THEN confidence END AS confidence,
         CASE WHEN error IS NULL THEN coalesce({_string('r')}, '') END AS reasoning,
         CASE WHEN error IS NULL THEN
           CASE WHEN t IN ('variable', 'function', 'class', 'method', 'property') THEN t ELSE 'variable' END
         END AS type, error
  FROM checked
  UNION ALL
  SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL,
         CASE WHEN answer IS NULL THEN 'No JSON found in response'
              ELSE 'Response does not contain a suggestions array' END
  FROM lists WHERE items IS NULL)"""


@register("parsed_suggestions", with_ctes(
    rel.RESPONSES_SQL, ANSWER_SQL, PARSED_SQL, body="SELECT * FROM parsed"))
def parsed_suggestions(spark, sf_dir):
    return op.parse_suggestions(rel.responses(spark, sf_dir))


def _shape(pattern: str) -> str:
    return (f"list_zip(regexp_extract_all(payload, '{pattern}', 1), "
            f"regexp_extract_all(payload, '{pattern}', 2))")


FALLBACK_SQL = rf"""
fallback AS (
  SELECT request_id, (generate_subscripts(l, 1) - 1)::BIGINT AS ordinal, unnest(l) AS p, as_text
  FROM (SELECT request_id, as_text, ({_shape(r'(?i)rename\s+(\w+)\s+to\s+(\w+)')} || {_shape(r'(\w+)\s*->\s*(\w+)')}
                 || {_shape(r'(\w+)\s*=>\s*(\w+)')}) AS l
        FROM (SELECT request_id, payload, items IS NULL AS as_text FROM lists)))"""
FALLBACK_ROWS = """request_id, ordinal, p[1] AS original_name, p[2] AS suggested_name,
       0.5::DOUBLE AS confidence, 'Extracted from text response' AS reasoning, 'variable' AS type"""


@register("rename_text_fallback", with_ctes(
    rel.RESPONSES_SQL, ANSWER_SQL, FALLBACK_SQL, body=f"SELECT {FALLBACK_ROWS} FROM fallback"))
def rename_text_fallback(spark, sf_dir):
    return op.parse_text_fallback(rel.responses(spark, sf_dir))


@register("parsed_with_fallback", with_ctes(
    rel.RESPONSES_SQL, ANSWER_SQL, PARSED_SQL, FALLBACK_SQL, body=f"""
SELECT * FROM parsed WHERE request_id NOT IN (SELECT request_id FROM fallback WHERE as_text)
UNION ALL SELECT {FALLBACK_ROWS}, NULL FROM fallback WHERE as_text"""))
def parsed_with_fallback(spark, sf_dir):
    return op.parse_with_fallback(rel.responses(spark, sf_dir))


@register("repaired_json", with_ctes(rel.RESPONSES_SQL, body=r"""
SELECT request_id, regexp_replace(payload, '\},\s*\]', '}]') AS payload FROM responses"""))
def repaired_json(spark, sf_dir):
    return op.repair_json(rel.responses(spark, sf_dir))


@register("rename_parallel_arrays", with_ctes(rel.RESPONSES_SQL, body=r"""
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY i, j) - 1 AS ordinal, p[1] AS name, p[2] AS new_name
FROM (SELECT request_id, i, generate_subscripts(l, 1) AS j, unnest(l) AS p
      FROM (SELECT request_id, i, list_zip(n[1:least(len(n), len(m))], m[1:least(len(n), len(m))]) AS l
            FROM (SELECT request_id, i,
                    CASE WHEN json_type(item, '$.name') = 'ARRAY' THEN (item->'$.name')::VARCHAR[] ELSE [item->>'$.name'] END AS n,
                    CASE WHEN json_type(item, '$.newName') = 'ARRAY' THEN (item->'$.newName')::VARCHAR[] ELSE [item->>'$.newName'] END AS m
                  FROM (SELECT request_id, unnest(items) AS item, generate_subscripts(items, 1) AS i
                        FROM (SELECT request_id, CASE WHEN json_valid(payload) AND NOT regexp_matches(payload, ',\s*[\]}]')
                                AND json_type(payload) = 'ARRAY' THEN json_extract(payload, '$[*]') END AS items FROM responses))
                  WHERE item->>'$.name' IS NOT NULL AND item->>'$.newName' IS NOT NULL)))"""))
def rename_parallel_arrays(spark, sf_dir):
    return op.pair_parallel_arrays(rel.responses(spark, sf_dir))


@register("best_suggestion", with_ctes(rel.SUGGESTIONS_SQL, body="""
SELECT unit_id, original_name, suggested_name, confidence, reasoning, type, chunk_index, ordinal FROM (
  SELECT *, row_number() OVER (PARTITION BY unit_id, original_name
                               ORDER BY confidence DESC, chunk_index, ordinal) AS rn FROM suggestions)
WHERE rn = 1"""))
def best_suggestion(spark, sf_dir):
    return op.best_suggestions(rel.suggestions(spark, sf_dir))


@register("overall_confidence", with_ctes(rel.SUGGESTIONS_SQL, body="""
SELECT unit_id, count(*) AS n,
       coalesce(sum(confidence::DECIMAL(18,6))::DOUBLE / count(confidence), 0) AS confidence
FROM suggestions GROUP BY unit_id"""))
def overall_confidence(spark, sf_dir):
    return op.overall_confidence(rel.suggestions(spark, sf_dir))


@register("confidence_warnings", with_ctes(rel.SUGGESTIONS_SQL, body="""
SELECT unit_id, offered, applied, mean, array_to_string(list_filter([
    CASE WHEN offered > applied THEN (offered - applied) || ' suggestions excluded due to low confidence (< 30%)' END,
    CASE WHEN mean < 0.6 THEN 'Average confidence is low (' || tenths // 10 || '.' || tenths % 10
         || '%), consider manual review' END], lambda x: x IS NOT NULL), '; ') AS warnings
FROM (SELECT *, floor(mean * 1000 + 0.5)::BIGINT AS tenths FROM (
  SELECT unit_id, count(*) AS offered, count(*) FILTER (WHERE confidence >= 0.3) AS applied,
    coalesce(sum(confidence::DECIMAL(18,6)) FILTER (WHERE confidence >= 0.3)::DOUBLE
             / nullif(count(*) FILTER (WHERE confidence >= 0.3), 0), 0) AS mean
  FROM suggestions GROUP BY unit_id))"""))
def confidence_warnings(spark, sf_dir):
    return op.quality_warnings(rel.suggestions(spark, sf_dir)).withColumn(
        "warnings", F.array_join("warnings", "; "))


# The tokens of a script, and the neighbours that decide whether a name is free.
TOKEN_RE = r"""'"[^"\\\n]*(?:\\.[^"\\\n]*)*"|''[^''\\\n]*(?:\\.[^''\\\n]*)*''|//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|[\p{L}\p{N}_$]+|[^\p{L}\p{N}_$"''/]+|["''/]'"""
TOKENISED_SQL = f"""
tokenised AS (SELECT unit_id, code, regexp_extract_all(code, {TOKEN_RE}) AS toks FROM scripts)"""


def _maps_sql(source: str) -> str:
    return f"""
maps AS (
  SELECT unit_id, map_from_entries(list((original_name, suggested_name))) AS m FROM {source} GROUP BY unit_id)"""


# Tokens with their neighbours; the end of a token leads to the text behind it.
PLACED_SQL = r"""
tk AS (SELECT unit_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM tokenised),
placed AS (
  SELECT unit_id, i, t, e, CASE WHEN p1 = '' THEN rtrim(p2) ELSE p1 END AS bef,
         trim(n1, ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS aft
  FROM (SELECT unit_id, i, t, rtrim(regexp_replace(lag(t, 1, '') OVER w, '\s+$', '')) AS p1,
               lag(t, 2, '') OVER w AS p2, lead(t, 1, '') OVER w AS n1, sum(length(t)) OVER w AS e
        FROM tk WINDOW w AS (PARTITION BY unit_id ORDER BY i))),
free AS (
  SELECT p.unit_id, p.i, p.t, b.suggested_name
  FROM placed p JOIN best b ON b.unit_id = p.unit_id AND b.original_name = p.t JOIN scripts s ON s.unit_id = p.unit_id
  WHERE NOT ((ends_with(bef, '.') AND NOT ends_with(bef, '...'))
    OR (starts_with(aft, ':') AND regexp_matches(bef, '[{,]$'))
    OR (starts_with(aft, '(') AND (regexp_matches(bef, '[{};]$') OR bef IN ('static', 'async', 'get', 'set'))
        AND regexp_matches(substring(s.code, e::BIGINT + 1), '^\s*\([^()]*\)\s*\{'))))"""


@register("rename_applied", with_ctes(
    rel.SCRIPTS_SQL, rel.RENAMES_SQL, rel.BEST_RENAMES_SQL, TOKENISED_SQL, PLACED_SQL, body="""
SELECT s.unit_id, coalesce(r.code, '') AS code FROM scripts s LEFT JOIN (
  SELECT k.unit_id, string_agg(coalesce(f.suggested_name, k.t), '' ORDER BY k.i) AS code
  FROM tk k LEFT JOIN free f ON f.unit_id = k.unit_id AND f.i = k.i GROUP BY k.unit_id) r ON r.unit_id = s.unit_id"""))
def rename_applied(spark, sf_dir):
    return op.apply_by_token(rel.scripts(spark, sf_dir), rel.renames(spark, sf_dir))


LAST_SQL = """
last_renames AS (
  SELECT unit_id, original_name, arg_max(suggested_name, ordinal) AS suggested_name
  FROM renames GROUP BY unit_id, original_name)"""


@register("rename_everywhere", with_ctes(
    rel.SCRIPTS_SQL, rel.RENAMES_SQL, LAST_SQL, TOKENISED_SQL, _maps_sql("last_renames"), body=f"""
SELECT unit_id, CASE WHEN m IS NULL THEN code ELSE array_to_string(list_transform(toks,
    lambda t: CASE WHEN m[t] IS NULL THEN t WHEN m[t] IN ({RESERVED_SQL}) THEN m[t] || '$' ELSE m[t] END), '') END AS code
FROM tokenised LEFT JOIN maps USING (unit_id)"""))
def rename_everywhere(spark, sf_dir):
    return op.apply_everywhere(rel.scripts(spark, sf_dir), rel.renames(spark, sf_dir))


CHANGED = r"""regexp_replace(code, '\b' || regexp_escape(original_name) || '\b',
              replace(suggested_name, '\', '\\'), 'g')"""


def _escapes_of(expr: str) -> str:
    return BAD_ESCAPES.replace("code", expr)


@register("rename_in_sequence", with_ctes(
    rel.SCRIPTS_SQL, rel.RENAMES_SQL, rel.BEST_RENAMES_SQL, f"""
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY length(original_name) DESC, original_name) AS k
  FROM best WHERE length(original_name) > 1),
applied AS (
  SELECT unit_id, code, 0::BIGINT AS k FROM scripts
  UNION ALL
  SELECT a.unit_id, CASE WHEN {_escapes_of(CHANGED)} > {BAD_ESCAPES} THEN code ELSE {CHANGED} END, o.k
  FROM applied a JOIN ordered o ON o.unit_id = a.unit_id AND o.k = a.k + 1)""", body="""
SELECT unit_id, code FROM (
  SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY k DESC) AS rn FROM applied) WHERE rn = 1"""))
def rename_in_sequence(spark, sf_dir):
    return op.apply_in_sequence(rel.scripts(spark, sf_dir), rel.renames(spark, sf_dir))


HITS_SQL = """
hits AS (
  SELECT b.unit_id, b.original_name, b.suggested_name, count(f.t) AS n
  FROM best b LEFT JOIN free f ON f.unit_id = b.unit_id AND f.t = b.original_name GROUP BY ALL)"""


@register("rename_hits", with_ctes(
    rel.SCRIPTS_SQL, rel.RENAMES_SQL, rel.BEST_RENAMES_SQL, TOKENISED_SQL, PLACED_SQL, HITS_SQL,
    body="SELECT * FROM hits"))
def rename_hits(spark, sf_dir):
    return op.rename_hits(rel.scripts(spark, sf_dir), rel.renames(spark, sf_dir))


@register("rename_totals", with_ctes(
    rel.SCRIPTS_SQL, rel.RENAMES_SQL, rel.BEST_RENAMES_SQL, TOKENISED_SQL, PLACED_SQL, HITS_SQL, body="""
SELECT unit_id, count(*) AS offered, count(*) FILTER (WHERE n > 0) AS applied, sum(n)::BIGINT AS occurrences
FROM hits GROUP BY unit_id"""))
def rename_totals(spark, sf_dir):
    return op.rename_totals(op.rename_hits(rel.scripts(spark, sf_dir), rel.renames(spark, sf_dir)))


@register("malformed_renames", with_ctes(rel.SUGGESTIONS_SQL, body="""
SELECT ordinal, 'Each rename operation must have name and newName strings' AS reason
FROM suggestions WHERE ordinal % 6 = 0 OR ordinal % 11 = 0"""))
def malformed_renames(spark, sf_dir):
    broken = rel.suggestions(spark, sf_dir).withColumns({
        "original_name": F.when(F.col("ordinal") % 6 != 0, F.col("original_name")),
        "suggested_name": F.when(F.col("ordinal") % 11 == 0, "").otherwise(F.col("suggested_name")),
    })
    return op.split_malformed(broken)[1].select("ordinal", "reason")
