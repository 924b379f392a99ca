"""Cache keys. Every setting enters the key, at every depth; secrets never do."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Settings that must not influence, or leak into, a key.
SECRET_FIELDS = ("apiKey", "api_key", "token", "password")
KEY_LENGTH = 32
CHAIN_KEY_LENGTH = 16


def _public(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _public(v) for k, v in value.items() if k not in SECRET_FIELDS}
    if isinstance(value, (list, tuple)):
        return [_public(v) for v in value]
    return value


def canonical_settings(settings: dict[str, Any]) -> str:
    """JSON with sorted names at every depth, without secrets."""
    return json.dumps(_public(settings), sort_keys=True, separators=(",", ":"))


def unit_key(code: Column, settings: Column) -> Column:
    """Key of a text under canonical settings: 32 hex digits."""
    joined = F.concat_ws("|", F.sha2(code, 256), settings)
    return F.left(F.sha2(joined, 256), F.lit(KEY_LENGTH))


def chain_key(steps: Column, settings: Column) -> Column:
    """Key of a chain of steps (array of names in order) and its settings: 16 hex digits."""
    joined = F.concat_ws("|", F.array_join(steps, ","), settings)
    return F.left(F.sha2(joined, 256), F.lit(CHAIN_KEY_LENGTH))


def entry_size(payload: Column) -> Column:
    """Estimated bytes of a cache entry: two per character of its JSON form."""
    return F.length(payload).cast("long") * 2


def json_string(text: Column) -> Column:
    """The JSON form of a plain string, quotes included."""
    array_form = F.to_json(F.array(text))
    return F.substring(array_form, F.lit(2), F.length(array_form) - 2)
