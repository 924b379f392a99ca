"""Prompts, calls, routing, limits and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..operators import chunking as ck
from ..operators import inference as op
from ..schemas import RESPONSES
from ..session import scratch_folder
from ..sources import catalog as cat
from ..streaming.calls import answer_stream
from . import relations as rel
from .chunks import _overlap_sql
from .files import CATALOG_SQL
from .measure import LINES
from .registry import register, with_ctes

FORM_SQL = "CASE provider " + " ".join(
    f"WHEN {rel.sql_text(p)} THEN {rel.sql_text(t)}" for p, t in pr.ANSWER_FORM.items()) + " END"


def prompt_sql(code: str) -> str:
    lines = LINES.replace("code", code)
    words = f"len(regexp_extract_all({code}, 'function'))"
    return f"""{rel.sql_text(pr.SYSTEM_PROMPT)} || chr(10) || chr(10)
      || 'Suggest better names for this script.' || chr(10) || chr(10) || 'Lines: ' || {lines}
      || chr(10) || 'Characters: ' || length({code}) || chr(10) || 'Estimated complexity: '
      || CASE WHEN {lines} > 1000 OR {words} > 50 THEN 'high'
              WHEN {lines} > 300 OR {words} > 15 THEN 'medium' ELSE 'low' END
      || chr(10) || chr(10) || '```javascript' || chr(10) || {code} || chr(10) || '```' || chr(10) || {FORM_SQL}"""


PROVIDER_SQL = rel.pick_sql([rel.sql_text(p) for p in rel.PROVIDERS], "chunk_index")
REQUESTS_SQL = f"""
requests AS (
  SELECT request_id, unit_id, chunk_index, provider, {prompt_sql('text')} AS prompt
  FROM (SELECT unit_id || '#' || chunk_index AS request_id, unit_id, chunk_index,
               substring(code, s + 1, e - s) AS text, {PROVIDER_SQL} AS provider
        FROM cuts))"""


def script_requests(spark, sf_dir):
    chunks = ck.overlap_chunks(rel.scripts(spark, sf_dir))
    provider = rel.pick([F.lit(p) for p in rel.PROVIDERS], F.col("chunk_index"))
    return op.build_requests(chunks, provider, F.lit("any"))


SCRIPT_CUTS_SQL = _overlap_sql(4000, 400).replace("FROM units", "FROM scripts")


@register("inference_requests", with_ctes(rel.SCRIPTS_SQL, SCRIPT_CUTS_SQL, REQUESTS_SQL, body="""
SELECT request_id, unit_id, chunk_index, provider, 'any' AS model, prompt,
       0.3::DOUBLE AS temperature, 4000::BIGINT AS max_tokens FROM requests"""))
def inference_requests(spark, sf_dir):
    return script_requests(spark, sf_dir)


def offline_client():
    """A stand-in for a model service: its answer, and its failures, follow from the prompt."""
    seen: dict[str, int] = {}

    def call(request):
        n, rid = len(request["prompt"]), request["request_id"]
        seen[rid] = seen.get(rid, 0) + 1
        if n % 7 == 0:
            raise RuntimeError("Unauthorized")
        if n % 5 == 0:
            raise RuntimeError("Server error")
        if n % 3 == 0 and seen[rid] == 1:
            raise RuntimeError("Network timeout")
        return f'{{"suggestions":[{{"name":"n{n}","newName":"len{n}","confidence":0.5}}]}}', n // 4

    return call


def no_wait(_seconds: float) -> None:
    """The stand-in needs no pause between attempts."""


@register("inference_responses", with_ctes(rel.SCRIPTS_SQL, SCRIPT_CUTS_SQL, REQUESTS_SQL, body="""
SELECT request_id,
  CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN NULL
       ELSE '{"suggestions":[{"name":"n' || n || '","newName":"len' || n || '","confidence":0.5}]}' END AS payload,
  CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN 0 ELSE n // 4 END::BIGINT AS tokens_used,
  CASE WHEN n % 7 = 0 THEN 1 WHEN n % 5 = 0 THEN 3 WHEN n % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts,
  CASE WHEN n % 7 = 0 THEN 'non_retryable' WHEN n % 5 = 0 THEN 'exhausted' END AS error_class,
  CASE WHEN n % 7 = 0 THEN 'Unauthorized' WHEN n % 5 = 0 THEN 'Server error' END AS error_message
FROM (SELECT request_id, length(prompt) AS n FROM requests)"""))
def inference_responses(spark, sf_dir):
    answers = op.run_inference(
        script_requests(spark, sf_dir), offline_client, threads=4, sleep=no_wait)
    return op.latest_responses(answers).drop("ms")


@register("logged_responses", with_ctes(rel.SCRIPTS_SQL, SCRIPT_CUTS_SQL, REQUESTS_SQL, body="""
SELECT request_id, CASE WHEN n % 7 = 0 THEN 'non_retryable' WHEN n % 5 = 0 THEN 'exhausted' END AS error_class,
       CASE WHEN n % 7 <> 0 AND n % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS calls
FROM (SELECT request_id, length(prompt) AS n FROM requests)"""))
def logged_responses(spark, sf_dir):
    """The requests as a stream into a log of answers, and all of them once more with a new
    checkpoint: only those that may still be answered are called again."""
    asked, log = scratch_folder(spark, "requests"), scratch_folder(spark, "answers")
    requests = script_requests(spark, sf_dir)
    requests.write.parquet(asked)
    for _ in range(2):
        stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 4).parquet(asked)
        answer_stream(stream, log, scratch_folder(spark, "progress"), offline_client, threads=4,
                      sleep=no_wait).awaitTermination()
    return spark.read.schema(RESPONSES).parquet(log).groupBy("request_id").agg(
        F.max("error_class").alias("error_class"), F.count(F.lit(1)).alias("calls"))


ROUTING_SQL = "routing(variant, provider, lo, hi, model) AS (VALUES " + ", ".join(
    f"({rel.sql_text(v)}, {rel.sql_text(p)}, {lo}::BIGINT, {'NULL' if hi is None else hi}::BIGINT, {rel.sql_text(m)})"
    for v, p, lo, hi, m in cat.ROUTING_ROWS) + ")"
SIZES_SQL = f"""
sizes AS (
  SELECT unit_id, provider, size, CASE WHEN cheap AND provider <> 'ollama' THEN 0 ELSE size END AS eff, cheap
  FROM (SELECT 'document/' || doc_id AS unit_id, n_chars * 5 AS size, doc_id % 3 = 0 AS cheap,
               {rel.pick_sql([rel.sql_text(p) for p in rel.PROVIDERS], 'doc_id')} AS provider FROM documents))"""


def _sizes(spark, sf_dir):
    d = F.col("doc_id")
    return rel.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("document/"), d.cast("string")).alias("unit_id"),
        rel.pick([F.lit(p) for p in rel.PROVIDERS], d).alias("provider"),
        (F.col("n_chars") * 5).alias("size"), (d % 3 == 0).alias("cheap"))


@register("model_routing", with_ctes(ROUTING_SQL, SIZES_SQL, body="""
SELECT unit_id, s.provider, size, cheap, model AS recommended_model
FROM sizes s LEFT JOIN routing r ON r.variant = 'factory' AND r.provider = s.provider
  AND eff >= lo AND (hi IS NULL OR eff < hi)"""))
def model_routing(spark, sf_dir):
    return op.route_models(
        _sizes(spark, sf_dir), F.col("provider"), F.col("size"), F.col("cheap"))


@register("provider_routing", with_ctes(ROUTING_SQL, SIZES_SQL, body="""
SELECT unit_id, s.provider, size, cheap, model AS recommended_model
FROM sizes s LEFT JOIN routing r ON r.variant = 'provider' AND r.provider = s.provider
  AND size >= lo AND (hi IS NULL OR size < hi)"""))
def provider_routing(spark, sf_dir):
    return op.route_models(
        _sizes(spark, sf_dir), F.col("provider"), F.col("size"), variant="provider")


@register("token_limits", with_ctes(rel.CALLS_SQL, CATALOG_SQL, body="""
SELECT request_id, provider, model, coalesce(
    (SELECT any_value(token_limit) FROM catalog k WHERE k.provider = c.provider AND k.model = c.model),
    CASE WHEN provider = 'ollama' THEN CASE split_part(model, ':', 1)
        WHEN 'llama3' THEN 128000 WHEN 'codellama' THEN 16384 WHEN 'mistral' THEN 32768 WHEN 'qwen2' THEN 32768 END END,
    CASE provider WHEN 'anthropic' THEN 200000 WHEN 'ollama' THEN 4096 ELSE 8192 END)::BIGINT AS token_limit
FROM calls c"""))
def token_limits(spark, sf_dir):
    return op.token_limits(rel.calls(spark, sf_dir).select("request_id", "provider", "model"))


COSTS_SQL = """
costs AS (
  SELECT c.*, input_tokens / 1000.0::DOUBLE
           * coalesce(k.in_per_1k, CASE provider WHEN 'anthropic' THEN 0.003 WHEN 'ollama' THEN 0 ELSE 0.005 END)::DOUBLE
         + output_tokens / 1000.0::DOUBLE
           * coalesce(k.out_per_1k, CASE provider WHEN 'ollama' THEN 0 ELSE 0.015 END)::DOUBLE AS cost
  FROM calls c LEFT JOIN catalog k USING (provider, model))"""


@register("request_cost", with_ctes(rel.CALLS_SQL, CATALOG_SQL, COSTS_SQL, body="""
SELECT request_id, provider, model, round(cost, 9) AS cost FROM costs"""))
def request_cost(spark, sf_dir):
    return op.request_costs(rel.calls(spark, sf_dir)).select(
        "request_id", "provider", "model", F.round("cost", 9).alias("cost"))


@register("cost_comparison", with_ctes(rel.CALLS_SQL, body="""
SELECT request_id, provider, model,
       round(input_tokens / 1000.0::DOUBLE * i + output_tokens / 1000.0::DOUBLE * o, 9) AS cost
FROM (SELECT request_id, input_tokens, output_tokens FROM calls),
     (VALUES ('anthropic', 'claude-3-5-sonnet-20241022', 0.003::DOUBLE, 0.015::DOUBLE),
             ('openai', 'gpt-4o', 0.005::DOUBLE, 0.015::DOUBLE)) m(provider, model, i, o)"""))
def cost_comparison(spark, sf_dir):
    loads = rel.calls(spark, sf_dir).select("request_id", "input_tokens", "output_tokens")
    return op.compare_costs(loads).select(
        "request_id", "provider", "model", F.round("cost", 9).alias("cost"))


@register("provider_usage", with_ctes(rel.CALLS_SQL, body="""
SELECT provider, count(*) AS requests, sum(tokens_used)::BIGINT AS tokens,
       floor(sum(tokens_used) / count(*) + 0.5)::BIGINT AS mean_tokens FROM calls GROUP BY provider"""))
def provider_usage(spark, sf_dir):
    return op.provider_usage(rel.calls(spark, sf_dir))
