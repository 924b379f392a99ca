"""Run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as nm
from ..operators import report as op
from . import relations as rel
from .registry import register, with_ctes

SUMMARY = """count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed,
       sum(tokens)::BIGINT AS tokens, sum(ms::DECIMAL(18,6))::DOUBLE AS ms"""


@register("run_summary", with_ctes(rel.RUN_LOG_SQL, body=f"SELECT {SUMMARY} FROM run_log"))
def run_summary(spark, sf_dir):
    return op.run_summary(rel.run_log(spark, sf_dir))


@register("run_summary_by_step", with_ctes(
    rel.RUN_LOG_SQL, body=f"SELECT step, {SUMMARY} FROM run_log GROUP BY step"))
def run_summary_by_step(spark, sf_dir):
    return op.run_summary(rel.run_log(spark, sf_dir), ["step"])


@register("error_metrics", with_ctes(rel.RUN_LOG_SQL, body="""
SELECT CASE WHEN grouping(step) = 0 THEN 'step' WHEN grouping(code) = 0 THEN 'code' ELSE 'total' END AS scope,
       coalesce(step, code, 'all') AS name, count(*) AS errors, count(*) FILTER (WHERE recoverable) AS recoverable
FROM run_log WHERE NOT ok GROUP BY GROUPING SETS ((), (step), (code))"""))
def error_metrics(spark, sf_dir):
    return op.error_metrics(rel.run_log(spark, sf_dir).filter(~F.col("ok")))


def _too_long(limit):
    return lambda code: F.when(
        F.length(code) > limit, F.concat(F.lit("too long: "), F.length(code).cast("string")))


STEPS = (
    op.Step("unpack", lambda c: F.replace(c, F.lit(";"), F.lit(";\n")), _too_long(3000)),
    op.Step("rename", lambda c: F.replace(c, F.lit("the"), F.lit("The")), _too_long(6000),
            recoverable=False, error_code="LLM_REQUEST_FAILED"),
    op.Step("format", nm.normalize_whitespace, _too_long(2500)),
)
CHAIN_SQL = r"""
s1 AS (
  SELECT unit_id, CASE WHEN length(code) > 3000 THEN code ELSE replace(code, ';', ';' || chr(10)) END AS code,
         CASE WHEN length(code) > 3000
              THEN ['Step ''unpack'' failed but was recovered: too long: ' || length(code)] ELSE [] END AS w
  FROM units),
s2 AS (
  SELECT unit_id, w, length(code) <= 6000 AS ok,
         CASE WHEN length(code) > 6000 THEN code ELSE replace(code, 'the', 'The') END AS code,
         CASE WHEN length(code) > 6000 THEN 'rename/LLM_REQUEST_FAILED/too long: ' || length(code) END AS error
  FROM s1),
s3 AS (
  SELECT unit_id, ok, error,
         CASE WHEN ok AND length(code) > 2500
              THEN w || ['Step ''format'' failed but was recovered: too long: ' || length(code)] ELSE w END AS w,
         CASE WHEN ok AND length(code) <= 2500
              THEN trim(regexp_replace(regexp_replace(code, '\s+', ' ', 'g'), ';\s*;', ';', 'g'), ' ') ELSE code END AS code
  FROM s2)"""


def _chain(spark, sf_dir):
    return op.run_steps(rel.units(spark, sf_dir), STEPS)


@register("step_chain", with_ctes(rel.UNITS_SQL, CHAIN_SQL, body="""
SELECT unit_id, code, ok, array_to_string(w, '; ') AS warnings, error FROM s3"""))
def step_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select(
        "unit_id", "code", "ok", F.array_join("warnings", "; ").alias("warnings"),
        F.when(F.col("error").isNotNull(),
               F.concat_ws("/", "error.step", "error.code", "error.message")).alias("error"))


@register("stopped_units", with_ctes(rel.UNITS_SQL, CHAIN_SQL, body="""
SELECT unit_id, split_part(error, '/', 1) AS step, split_part(error, '/', 2) AS code,
       split_part(error, '/', 3) AS message FROM s3 WHERE NOT ok"""))
def stopped_units(spark, sf_dir):
    return op.split_failed(_chain(spark, sf_dir))[1]


@register("step_results_by_kind", with_ctes(rel.UNITS_SQL, CHAIN_SQL, body="""
SELECT kind, count(*) AS units, count(*) FILTER (WHERE ok) AS finished,
       count(*) FILTER (WHERE len(w) > 0) AS with_warnings
FROM s3 JOIN units USING (unit_id) GROUP BY kind"""))
def step_results_by_kind(spark, sf_dir):
    """One result per input, whatever happened to it."""
    return _chain(spark, sf_dir).groupBy("kind").agg(
        F.count(F.lit(1)).alias("units"), F.count_if("ok").alias("finished"),
        F.count_if(F.size("warnings") > 0).alias("with_warnings"))


@register("bottlenecks", with_ctes(rel.SAMPLES_SQL, body="""
SELECT run_id, sample_id, 'memory' AS type, CASE WHEN heap_mb > 1000 THEN 'high' ELSE 'medium' END AS severity,
       CASE WHEN heap_mb > 1000 THEN 0.8 ELSE 0.4 END::DOUBLE AS impact, floor(heap_mb + 0.5)::BIGINT AS measured,
       CASE WHEN heap_mb > 1000 THEN 'Heap use is high: ' ELSE 'Heap use is raised: ' END || floor(heap_mb + 0.5)::BIGINT || ' MB' AS description,
       CASE WHEN heap_mb > 1000 THEN 'Process in smaller chunks, or stream instead of holding whole texts'
            ELSE 'Watch the heap, and trim what is kept if it grows' END AS suggestion
FROM samples WHERE heap_mb > 500
UNION ALL SELECT run_id, sample_id, 'cpu', 'high', 0.7, floor(cpu * 100 + 0.5)::BIGINT,
  'CPU is nearly used up: ' || floor(cpu * 100 + 0.5)::BIGINT || ' %', 'Run fewer tasks at a time, or give them more cores'
FROM samples WHERE cpu > 0.9
UNION ALL SELECT run_id, sample_id, 'io', 'medium', 0.6, floor(seconds + 0.5)::BIGINT,
  'The run takes long: ' || floor(seconds + 0.5)::BIGINT || ' s', 'Spread the work over more tasks, or reuse cached answers'
FROM samples WHERE seconds > 300"""))
def bottlenecks(spark, sf_dir):
    return op.bottlenecks(rel.samples(spark, sf_dir))


@register("metric_means", with_ctes(rel.SAMPLES_SQL, body="""
SELECT name, sum(value::DECIMAL(18,6))::DOUBLE / count(value) AS mean, count(value) AS samples
FROM (SELECT 'throughput' AS name, throughput AS value FROM samples
      UNION ALL SELECT 'cpu', cpu FROM samples UNION ALL SELECT 'memory', memory FROM samples) GROUP BY name"""))
def metric_means(spark, sf_dir):
    long = rel.samples(spark, sf_dir).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("value"))
        for n in ("throughput", "cpu", "memory")])))
    return op.metric_means(long)


@register("throughput_trend", with_ctes(rel.SAMPLES_SQL, body="""
SELECT run_id, sample_id, trend, CASE WHEN trend < -0.1 THEN 'reduce'
    WHEN trend > 0.1 AND cpu < 0.8 AND memory < 0.8 THEN 'increase'
    WHEN trend IS NOT NULL THEN 'keep' END AS advice
FROM (SELECT *, CASE WHEN n = 5 AND f <> 0 THEN (r - f) / f END AS trend
      FROM (SELECT *, count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n,
              sum(throughput::DECIMAL(18,6)) OVER (w ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING)::DOUBLE / 2 AS f,
              sum(throughput::DECIMAL(18,6)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DOUBLE / 3 AS r
            FROM samples WINDOW w AS (PARTITION BY run_id ORDER BY ts, sample_id)))"""))
def throughput_trend(spark, sf_dir):
    return op.throughput_trend(rel.samples(spark, sf_dir))


HINTS = ("Check the path", "Try an absolute path")


@register("formatted_errors", with_ctes(rel.RUN_LOG_SQL, body=f"""
SELECT unit_id, '❌ Error in ' || step || ': ' || message
  || CASE WHEN status >= 429 THEN chr(10) || chr(10) || '💡 Suggestions:' || chr(10) || '  • {HINTS[0]}' || chr(10)
          || '  • {HINTS[1]}' ELSE '' END
  || CASE WHEN recoverable THEN chr(10) || chr(10)
          || '🔄 This error is recoverable - attempting to continue...' ELSE '' END AS text
FROM run_log WHERE NOT ok"""))
def formatted_errors(spark, sf_dir):
    hints = F.array(*[F.lit(h) for h in HINTS])
    none = F.array().cast("array<string>")
    errors = rel.run_log(spark, sf_dir).filter(~F.col("ok")).withColumn(
        "suggestions", F.when(F.col("status") >= 429, hints).otherwise(none))
    return op.format_errors(errors).select("unit_id", "text")
