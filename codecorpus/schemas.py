"""Explicit schemas of the tables the operators exchange; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


S, L, D = T.StringType(), T.LongType(), T.DoubleType()

RESPONSES = _schema(
    request_id=S, payload=S, tokens_used=L, attempts=L, ms=D, error_class=S, error_message=S,
)

MODELS = _schema(
    ordinal=L, provider=S, model=S, in_per_1k=D, out_per_1k=D, token_limit=L,
)

ROUTING = _schema(provider=S, variant=S, lo=L, hi=L, model=S)
