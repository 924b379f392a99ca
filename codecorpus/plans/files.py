"""Path handling, the plan preview and the model listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalog as cat
from ..sources import files as fl
from . import relations as rel
from .registry import register, with_ctes

VALID_SQL = r"lower(regexp_extract(list_last(string_split(path, '/')), '^.+\.([^.]*)$', 1)) IN ('js', 'mjs', 'cjs')"
EXCLUDED_SQL = r"regexp_matches(path, '(^|/)(node_modules|\.git|dist|build)/')"


@register("selected_paths", with_ctes(rel.SCRIPTS_SQL, body=rf"""
SELECT unit_id, path FROM scripts
WHERE regexp_matches(path, '^(.*/)?[^/]*\.(js|mjs|cjs)$') AND NOT {EXCLUDED_SQL}
  AND NOT regexp_matches(path, '^(.*/)?pages/.*$') AND {VALID_SQL}"""))
def selected_paths(spark, sf_dir):
    return fl.select_paths(
        rel.scripts(spark, sf_dir).select("unit_id", "path"), exclude=("!**/pages/**",))


@register("distinct_paths", with_ctes(rel.SCRIPTS_SQL, body=r"""
SELECT DISTINCT path FROM scripts WHERE regexp_matches(path, '\.(js|mjs|cjs|JS)$')"""))
def distinct_paths(spark, sf_dir):
    paths = rel.scripts(spark, sf_dir).select("path")
    by_pattern = [paths.filter(fl.matches_any(F.col("path"), [p]))
                  for p in ("**/*.js", "**/*.[mc]js", "**/f*.{js,cjs}", "**/*.JS")]
    found = by_pattern[0]
    for more in by_pattern[1:]:
        found = found.unionByName(more)
    return fl.distinct_paths(found)


@register("valid_source_paths", with_ctes(
    rel.SCRIPTS_SQL, body=f"SELECT unit_id, path FROM scripts WHERE {VALID_SQL}"))
def valid_source_paths(spark, sf_dir):
    return fl.valid_paths(rel.scripts(spark, sf_dir).select("unit_id", "path"))


@register("plan_preview", with_ctes(rel.SCRIPTS_SQL, body=f"""
SELECT 'files' AS item, count(*)::VARCHAR AS value FROM scripts WHERE {VALID_SQL}
UNION ALL SELECT 'path', path FROM scripts WHERE {VALID_SQL}"""))
def plan_preview(spark, sf_dir):
    return fl.preview(fl.valid_paths(rel.scripts(spark, sf_dir)))


@register("output_paths", with_ctes(rel.SCRIPTS_SQL, body=r"""
SELECT unit_id, 'out/' || path AS mirrored, 'out/' || list_last(string_split(path, '/')) AS flat,
       regexp_replace(path, '(\.[^./]*)$', '.readable\1') AS beside FROM scripts"""))
def output_paths(spark, sf_dir):
    p = F.col("path")
    return rel.scripts(spark, sf_dir).select(
        "unit_id", fl.output_path(p, "out").alias("mirrored"),
        fl.output_path(p, "out/", keep_tree=False).alias("flat"),
        fl.output_path(p).alias("beside"))


# Names a model listing may hold.
LISTED = ("o4-mini", "o3", "o1-pro", "gpt-4o", "gpt-4.1-nano", "gpt-4-turbo", "gpt-3.5-turbo",
          "gpt-3.5-turbo-instruct", "gpt-4-0613", "tts-1", "whisper-1", "text-embedding-3",
          "omni-moderation", "custom", "gpt-4o-audio")
LISTING_SQL = f"""
listing AS (
  SELECT {rel.pick_sql([rel.sql_text(n) for n in LISTED], 'event_id')} || '-' || user_id AS model FROM events)"""


@register("ranked_models", with_ctes(LISTING_SQL, body=r"""
SELECT model, (CASE WHEN model LIKE 'o4%' THEN 7 WHEN model LIKE 'o3%' THEN 6 WHEN model LIKE 'o1%' THEN 5
    WHEN model LIKE 'gpt-4o%' THEN 4 WHEN model LIKE 'gpt-4.1%' THEN 3 WHEN model LIKE 'gpt-4%' THEN 2
    WHEN model LIKE 'gpt-3.5%' THEN 1 ELSE 0 END)::BIGINT AS rank
FROM (SELECT DISTINCT model FROM listing)
WHERE NOT regexp_matches(model, 'instruct|audio|realtime|search|transcribe|tts|whisper|dall-e|davinci|babbage|embedding|moderation|0301|0314|0613')"""))
def ranked_models(spark, sf_dir):
    listed = rel.table(spark, sf_dir, "events").select(
        F.concat(rel.pick([F.lit(n) for n in LISTED], F.col("event_id")), F.lit("-"),
                 F.col("user_id").cast("string")).alias("model"))
    return cat.ranked_models(listed)


CATALOG_SQL = "catalog(provider, model, in_per_1k, out_per_1k, token_limit) AS (VALUES " + ", ".join(
    f"({rel.sql_text(p)}, {rel.sql_text(m)}, {i}::DOUBLE, {o}::DOUBLE, {t}::BIGINT)"
    for _, p, m, i, o, t in cat.model_rows()) + ")"


@register("catalog_prices", with_ctes(rel.CALLS_SQL, CATALOG_SQL, body="""
SELECT provider, model, in_per_1k, out_per_1k, token_limit, count(*) AS calls
FROM calls JOIN catalog USING (provider, model) GROUP BY ALL"""))
def catalog_prices(spark, sf_dir):
    used = rel.calls(spark, sf_dir).groupBy("provider", "model").agg(F.count(F.lit(1)).alias("calls"))
    models = cat.models(spark).drop("ordinal")
    return used.join(F.broadcast(models), ["provider", "model"]).select(*models.columns, "calls")
