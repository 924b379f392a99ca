"""The fixed catalog of models, prices, limits and routing bands.

These tables have a fixed number of rows, none of which comes from data; that is what makes
them safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MODELS, ROUTING

# Provider, model, price per 1000 tokens in and out, context limit.
MODEL_ROWS = (
    ("anthropic", "claude-3-5-sonnet-20241022", 0.003, 0.015, 200000),
    ("anthropic", "claude-3-5-haiku-20241022", 0.00025, 0.00125, 200000),
    ("anthropic", "claude-3-opus-20240229", 0.015, 0.075, 200000),
    ("anthropic", "claude-3-sonnet-20240229", 0.003, 0.015, 200000),
    ("anthropic", "claude-3-haiku-20240307", 0.00025, 0.00125, 200000),
    ("openai", "gpt-4o", 0.005, 0.015, 128000),
    ("openai", "gpt-4o-mini", 0.00015, 0.0006, 128000),
    ("openai", "gpt-4-turbo", 0.01, 0.03, 128000),
    ("openai", "gpt-4", 0.03, 0.06, 8192),
    ("openai", "gpt-3.5-turbo", 0.0005, 0.0015, 16385),
    ("ollama", "llama3.1:8b", 0.0, 0.0, 128000),
    ("ollama", "llama3.1:70b", 0.0, 0.0, 128000),
    ("ollama", "llama3.2:1b", 0.0, 0.0, 32768),
    ("ollama", "llama3.2:3b", 0.0, 0.0, 32768),
    ("ollama", "codellama:7b", 0.0, 0.0, 16384),
    ("ollama", "codellama:13b", 0.0, 0.0, 16384),
    ("ollama", "codellama:34b", 0.0, 0.0, 16384),
    ("ollama", "mistral:7b", 0.0, 0.0, 32768),
    ("ollama", "qwen2:7b", 0.0, 0.0, 32768),
    ("ollama", "deepseek-coder:6.7b", 0.0, 0.0, 16384),
)

# Per provider the model whose price stands in for unknown models, the limit
# of unknown models, and whether a model family shares its limit.
DEFAULT_MODEL = {"anthropic": "claude-3-5-sonnet-20241022", "openai": "gpt-4o"}
DEFAULT_LIMIT = {"anthropic": 200000, "openai": 8192, "ollama": 4096}
FAMILY_LIMITS = ("ollama",)
# The same offer under another name.
SAME_AS = {"azure": "openai"}

# Routing bands (variant, provider, from size, below size, model).
ROUTING_ROWS = (
    ("factory", "anthropic", 0, 10000, "claude-3-5-haiku-20241022"),
    ("factory", "anthropic", 10000, 50000, "claude-3-5-sonnet-20241022"),
    ("factory", "anthropic", 50000, None, "claude-3-opus-20240229"),
    ("factory", "openai", 0, 5000, "gpt-4o-mini"),
    ("factory", "openai", 5000, 20000, "gpt-4o"),
    ("factory", "openai", 20000, None, "gpt-4-turbo"),
    ("factory", "azure", 0, 5000, "gpt-4o-mini"),
    ("factory", "azure", 5000, 20000, "gpt-4o"),
    ("factory", "azure", 20000, None, "gpt-4-turbo"),
    ("factory", "ollama", 0, 10000, "codellama:13b"),
    ("factory", "ollama", 10000, None, "codellama:34b"),
    ("provider", "anthropic", 0, 10000, "claude-3-5-haiku-20241022"),
    ("provider", "anthropic", 10000, 50000, "claude-3-5-sonnet-20241022"),
    ("provider", "anthropic", 50000, None, "claude-3-opus-20240229"),
    ("provider", "openai", 0, 5000, "gpt-4o-mini"),
    ("provider", "openai", 5000, 20000, "gpt-4o"),
    ("provider", "openai", 20000, 50000, "gpt-4-turbo"),
    ("provider", "openai", 50000, None, "gpt-4o"),
    ("provider", "ollama", 0, 5000, "codellama:7b"),
    ("provider", "ollama", 5000, 20000, "codellama:13b"),
    ("provider", "ollama", 20000, None, "llama3.1:8b"),
)

# Name parts of specialised or outdated models, and family ranks by prefix.
SPECIALISED = (
    "instruct", "audio", "realtime", "search", "transcribe", "tts", "whisper", "dall-e",
    "davinci", "babbage", "embedding", "moderation", "0301", "0314", "0613",
)
FAMILY_RANK = (
    ("o4", 7), ("o3", 6), ("o1", 5), ("gpt-4o", 4), ("gpt-4.1", 3), ("gpt-4", 2), ("gpt-3.5", 1),
)


def model_rows() -> list[tuple]:
    """The catalog with one set of rows per provider name, in catalog order."""
    rows = list(MODEL_ROWS)
    for alias, origin in SAME_AS.items():
        rows += [(alias, *r[1:]) for r in MODEL_ROWS if r[0] == origin]
    return [(i, *r) for i, r in enumerate(rows)]


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(model_rows(), MODELS)


def routing(spark: SparkSession, variant: str = "factory") -> DataFrame:
    rows = [(p, v, lo, hi, m) for v, p, lo, hi, m in ROUTING_ROWS if v == variant]
    return spark.createDataFrame(rows, ROUTING)


def limits_by_provider(spark: SparkSession) -> DataFrame:
    """One row per provider: limits as a list in catalog order and as a map."""
    rows = []
    for provider in ("anthropic", "openai", "azure", "ollama"):
        mine = [(r[2], r[5]) for r in model_rows() if r[1] == provider]
        origin = SAME_AS.get(provider, provider)
        rows.append((provider, mine, dict(mine), origin in FAMILY_LIMITS, DEFAULT_LIMIT[origin]))
    return spark.createDataFrame(
        rows,
        "provider string, limit_list array<struct<model:string,token_limit:bigint>>, "
        "limit_map map<string,bigint>, by_family boolean, default_limit bigint",
    )


def prices_by_provider(spark: SparkSession) -> DataFrame:
    """One row per provider: prices as a map and the price of unknown models."""
    rows = []
    for provider in ("anthropic", "openai", "azure", "ollama"):
        mine = {r[2]: (r[3], r[4]) for r in model_rows() if r[1] == provider}
        default = DEFAULT_MODEL.get(SAME_AS.get(provider, provider))
        rows.append((provider, mine, mine[default] if default else (0.0, 0.0)))
    price = "struct<in_per_1k:double,out_per_1k:double>"
    return spark.createDataFrame(
        rows, f"provider string, price_map map<string,{price}>, default_price {price}"
    )


def compared_models() -> list[tuple[str, str, float, float]]:
    """The default model of each provider that has prices: provider, model, in, out."""
    out = []
    for provider, model in DEFAULT_MODEL.items():
        row = next(r for r in MODEL_ROWS if r[0] == provider and r[1] == model)
        out.append((provider, model, row[2], row[3]))
    return out


def family_rank(name: Column) -> Column:
    rank = F.lit(0)
    for prefix, value in reversed(FAMILY_RANK):
        rank = F.when(name.startswith(prefix), value).otherwise(rank)
    return rank.cast("long")


def usable_models(listed: DataFrame) -> DataFrame:
    """Distinct general models of a listing (model), with their family rank.

    The listing is the caller's and may be long; only a report needs it sorted."""
    name = F.col("model")
    keep = name.isNotNull() & (name != "")
    for part in SPECIALISED:
        keep = keep & ~name.contains(part)
    return listed.select("model").filter(keep).distinct().withColumn("rank", family_rank(name))


def ranked_models(listed: DataFrame, top: int | None = None) -> DataFrame:
    """`usable_models` best family first, then by name."""
    ranked = usable_models(listed).orderBy(F.desc("rank"), "model")
    return ranked.limit(top) if top else ranked
