"""Batch inference: requests, routing, limits, cost, calls with retry, usage.

The client is the caller's. It is built once per task by a factory and called with one
request; the vendor protocol is its business.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions.prompts import full_prompt
from ..functions.text import js_round
from ..schemas import RESPONSES
from ..sources import catalog as cat

# A client takes a request (dict of its columns) and returns (payload, tokens used).
Client = Callable[[dict[str, Any]], tuple[str, int]]

# Request defaults and retry settings.
TEMPERATURE = 0.3
MAX_TOKENS = 4_000
MAX_ATTEMPTS = 3
BASE_DELAY = 1.0
JITTER = 0.1

#: Answers a task hands over together: so many, or those of so many seconds.
ANSWERS, SECONDS = 200, 5.0


def build_requests(
    chunks: DataFrame, provider: Column, model: Column,
    temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """One request per chunk (unit_id, chunk_index, text)."""
    return chunks.select(
        F.concat_ws("#", "unit_id", F.col("chunk_index").cast("string")).alias("request_id"),
        "unit_id", "chunk_index",
        provider.alias("provider"), model.alias("model"),
        full_prompt(F.col("text"), provider).alias("prompt"),
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).cast("long").alias("max_tokens"),
    )


def _non_retryable(error: Exception) -> bool:
    """By the status an error carries: 429 and 500 or more may pass, others won't. Without one, by
    its message."""
    status = getattr(error, "status", None) or getattr(error, "status_code", None)
    if isinstance(status, int):
        return status != 429 and status < 500
    low = str(error).lower()
    return any(part in low for part in cl.NON_RETRYABLE)


def _call(
    client: Client, request: dict[str, Any], max_attempts: int, base_delay: float,
    sleep: Callable[[float], None],
) -> dict[str, Any]:
    started = time.perf_counter()
    row: dict[str, Any] = {"request_id": request["request_id"], "payload": None, "tokens_used": 0}
    for attempt in range(1, max_attempts + 1):
        row.update(attempts=attempt, error_class=None, error_message=None)
        try:
            row["payload"], row["tokens_used"] = client(request)
            break
        except Exception as error:  # a failed call is a result row, never a failed job
            message = str(error)
            row["error_message"] = message
            if _non_retryable(error):
                row["error_class"] = "non_retryable"
                break
            row["error_class"] = "exhausted"
            if attempt < max_attempts:
                delay = base_delay * 2 ** (attempt - 1)
                sleep(delay + random.random() * JITTER * delay)
    row["ms"] = (time.perf_counter() - started) * 1000
    return row


def _gathered(rows: Iterator[dict[str, Any]], answers: int, seconds: float) -> Iterator[pd.DataFrame]:
    """Rows in frames: so many, or those of so many seconds."""
    names = [f.name for f in RESPONSES.fields]
    held: list[dict[str, Any]] = []
    since = 0.0
    for row in rows:
        since = since if held else time.monotonic()
        held.append(row)
        if len(held) >= answers or time.monotonic() - since >= seconds:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def run_inference(
    requests: DataFrame,
    client_factory: Callable[[], Client],
    partitions: int | None = None,
    threads: int = 1,
    max_attempts: int = MAX_ATTEMPTS,
    base_delay: float = BASE_DELAY,
    sleep: Callable[[float], None] = time.sleep,
    answers: int = ANSWERS,
    seconds: float = SECONDS,
) -> DataFrame:
    """Responses of all requests, one row each, failed ones included.

    Calls in flight are bounded by tasks times `threads`. Requests are spread round-robin
    when `partitions` is given, so an expensive unit does not keep one task busy. Answers are
    handed over when there are `answers` of them or the first has waited `seconds`, at the next
    answer. A task may run twice; write the result and keep one row per request with
    `latest_responses`, or let `answer_stream` keep a log.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        with ThreadPoolExecutor(max_workers=threads) as pool:
            yield from _gathered((
                row for batch in batches for row in pool.map(
                    lambda r: _call(client, r, max_attempts, base_delay, sleep), batch.to_dict("records"))), answers, seconds)

    spread = requests.repartition(partitions) if partitions else requests
    return spread.mapInPandas(run, RESPONSES)


def latest_responses(responses: DataFrame) -> DataFrame:
    """One response per request; an answered one before a failed one."""
    rest = [c for c in responses.columns if c != "request_id"]
    order = F.struct(F.col("payload").isNotNull().alias("answered"), *rest)
    return responses.groupBy("request_id").agg(F.max(order).alias("r")).select(
        "request_id", *[F.col(f"r.{c}").alias(c) for c in rest]
    )


def route_models(
    units: DataFrame, provider: Column, size: Column, prioritize_cost: Column | None = None,
    variant: str = "factory",
) -> DataFrame:
    """Adds the recommended model. Size bands are half-open and without gaps; a priority on
    cost selects the first band of a cloud provider. The table is a fixed list, broadcast
    and joined on the provider with the band as the extra condition."""
    spark = units.sparkSession
    bands = F.broadcast(cat.routing(spark, variant).withColumnsRenamed(
        {"provider": "r_provider", "model": "recommended_model"}))
    effective = size
    if prioritize_cost is not None:
        cheap = prioritize_cost & provider.isin(*cl.CLOUD_PROVIDERS)
        effective = F.when(cheap, F.lit(0)).otherwise(size)
    keyed = units.withColumns({"_p": provider, "_s": effective.cast("long")})
    hit = (
        (F.col("_p") == F.col("r_provider"))
        & (F.col("_s") >= F.col("lo"))
        & (F.col("hi").isNull() | (F.col("_s") < F.col("hi")))
    )
    return keyed.join(bands, hit, "left").drop("_p", "_s", "r_provider", "lo", "hi", "variant")


def token_limits(requests: DataFrame) -> DataFrame:
    """Adds the context limit of the model: exact name, else the first catalog entry of the
    same family, else the default of the provider. One broadcast row per provider, so no
    request row ever multiplies."""
    limits = F.broadcast(cat.limits_by_provider(requests.sparkSession))
    family = F.element_at(F.split("model", ":"), 1)
    same_family = F.get(F.filter("limit_list", lambda m: m.model.startswith(family)), 0)
    return requests.join(limits, "provider", "left").withColumn(
        "token_limit",
        F.coalesce(
            F.try_element_at("limit_map", F.col("model")),
            F.when(F.col("by_family"), same_family["token_limit"]),
            F.col("default_limit"),
        ),
    ).drop("limit_list", "limit_map", "by_family", "default_limit")


def request_costs(requests: DataFrame) -> DataFrame:
    """Adds the cost of input_tokens and output_tokens; an unknown model has the default
    price of its provider, a local one costs nothing."""
    prices = F.broadcast(cat.prices_by_provider(requests.sparkSession))
    price = F.coalesce(F.try_element_at("price_map", F.col("model")), F.col("default_price"))
    return requests.join(prices, "provider", "left").withColumn(
        "cost", _cost(F.col("input_tokens"), F.col("output_tokens"), price)
    ).drop("price_map", "default_price")


def _cost(tokens_in: Column, tokens_out: Column, price: Column) -> Column:
    return (
        tokens_in / F.lit(1000.0) * price["in_per_1k"]
        + tokens_out / F.lit(1000.0) * price["out_per_1k"]
    )


def compare_costs(loads: DataFrame) -> DataFrame:
    """Cost of each token load at the default model of each compared provider."""
    options = F.array(*[
        F.struct(
            F.lit(p).alias("provider"), F.lit(m).alias("model"),
            F.lit(i).alias("in_per_1k"), F.lit(o).alias("out_per_1k"),
        )
        for p, m, i, o in cat.compared_models()
    ])
    rows = loads.withColumn("o", F.explode(options))
    return rows.select(
        *loads.columns, "o.provider", "o.model",
        _cost(F.col("input_tokens"), F.col("output_tokens"), F.col("o")).alias("cost"),
    )


def provider_usage(calls: DataFrame, providers: Sequence[str] = ()) -> DataFrame:
    """Requests, tokens and rounded mean per provider; zeros for given ones without calls."""
    requests = F.count("counted")
    tokens = F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("long")
    rows = calls.select("provider", "tokens_used", F.lit(1).alias("counted"))
    if providers:
        idle = calls.sparkSession.createDataFrame(
            [(p, None, None) for p in providers], "provider string, tokens_used long, counted int")
        rows = rows.unionByName(idle)
    usage = rows.groupBy("provider").agg(requests.alias("requests"), tokens.alias("tokens"))
    mean = F.try_divide(F.col("tokens").cast("double"), F.col("requests").cast("double"))
    return usage.withColumn("mean_tokens", F.coalesce(js_round(mean), F.lit(0).cast("long")))
