"""Predicates and classifiers over text, messages and request settings, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import line_count
from .text import WS, WS_CHARS, count_char, identifiers, let, matches_near, ratio

# The six signs of minified or obfuscated code, in reporting order.
INDICATORS = (
    "long_lines", "single_letter_vars", "has_encoding",
    "has_eval", "has_string_concat", "minified_structure",
)

# Thresholds of those signs.
LONG_LINE = 200
SHORT_SHARE = 0.3
MIN_SEMICOLONS = 10
SEMICOLONS_PER_LINE = 5
POSITIVE_AT = 2
MAX_UNIT_SIZE = 10 * 1024 * 1024

# Shapes that only typed dialects use, each with a text it cannot do without.
# The repeated part of the annotation is possessive: it cannot match in another way, and a
# long union must not deepen the stack.
TYPED_SHAPES = (
    (":", rf":{WS}*\w++(?:\[\])?+(?:{WS}*\|{WS}*\w++)*+{WS}*[=;,)]"),
    ("interface", rf"interface{WS}+\w"),
    ("type", rf"type{WS}+\w+{WS}*="),
    ("enum", rf"enum{WS}+\w"),
    ("<", r"<\w+>"),
    ("?", rf"\w\?{WS}*:"),
    ("p", rf"(?:public|private|protected){WS}"),
)

# Words no identifier may take.
RESERVED = (
    "abstract", "arguments", "await", "boolean", "break",
    "byte", "case", "catch", "char", "class",
    "const", "continue", "debugger", "default", "delete",
    "do", "double", "else", "enum", "eval",
    "export", "extends", "false", "final", "finally",
    "float", "for", "function", "goto", "if",
    "implements", "import", "in", "instanceof", "int",
    "interface", "let", "long", "native", "new",
    "null", "package", "private", "protected", "public",
    "return", "short", "static", "super", "switch",
    "synchronized", "this", "throw", "throws", "transient",
    "true", "try", "typeof", "var", "void",
    "volatile", "while", "with", "yield",
)

# Message parts that make another attempt pointless, and those that do not.
NON_RETRYABLE = (
    "unauthorized", "invalid api key", "forbidden",
    "quota", "billing", "insufficient funds",
    "invalid input", "malformed", "bad request",
)
RETRYABLE = ("timeout", "connection")

VALID_EXTENSIONS = ("js", "mjs", "cjs")
TYPED_EXTENSIONS = ("ts", "tsx")
DECIDING_EXTENSIONS = (*TYPED_EXTENSIONS, "jsx")


def mean_trimmed_line_length(code: Column) -> Column:
    total = F.aggregate(
        F.split(code, "\n", -1), F.lit(0).cast("long"),
        lambda acc, line: acc + F.length(F.btrim(line, F.lit(WS_CHARS))),
    )
    return ratio(total, line_count(code))


def short_name_share(tokens: Column) -> Column:
    """Share of one-letter names among identifier tokens; null without tokens."""
    return let(
        tokens,
        lambda ts: ratio(F.size(F.filter(ts, lambda t: F.length(t) == 1)), F.size(ts)),
    )


def has_many_short_names(tokens: Column) -> Column:
    return F.coalesce(short_name_share(tokens) > SHORT_SHARE, F.lit(False))


def has_few_line_breaks(code: Column) -> Column:
    """A text without any line break never counts: the ratio has no divisor."""
    semis, breaks = count_char(code, ";"), count_char(code, "\n")
    dense = F.coalesce(ratio(semis, breaks) > SEMICOLONS_PER_LINE, F.lit(False))
    return (semis > MIN_SEMICOLONS) & dense


# Signs of hidden text.
ESCAPES = r"(?i)\\x[0-9a-f]{2}|\\u[0-9a-f]{4}"
EVAL = rf"eval{WS}*\("
LITERAL_CONCAT = rf"""["'][^"']*["']{WS}*\+{WS}*["'][^"']*["']"""


def has_escapes(code: Column) -> Column:
    return matches_near(code, "\\", ESCAPES)


def has_eval(code: Column) -> Column:
    return matches_near(code, "eval", EVAL)


def has_literal_concat(code: Column) -> Column:
    return matches_near(code, "+", LITERAL_CONCAT)


def indicators(code: Column) -> dict[str, Column]:
    return {
        "long_lines": mean_trimmed_line_length(code) > LONG_LINE,
        "single_letter_vars": has_many_short_names(identifiers(code)),
        "has_encoding": has_escapes(code),
        "has_eval": has_eval(code),
        "has_string_concat": has_literal_concat(code),
        "minified_structure": has_few_line_breaks(code),
    }


def file_extension(path: Column) -> Column:
    """Lower-cased text after the last dot; the whole name when there is none."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def is_valid_source_path(path: Column) -> Column:
    """Case-insensitive extension check on the file name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)).isin(*VALID_EXTENSIONS)


def has_typed_syntax(code: Column) -> Column:
    hit = F.lit(False)
    for needle, pattern in TYPED_SHAPES:
        hit = hit | matches_near(code, needle, pattern)
    return hit


def has_markup_syntax(code: Column) -> Column:
    """Any opening or closing tag, unless the text starts as a markup comment.

    An opening tag is a ``<`` glued to a word character with some ``>`` after it. Looking
    for that ``>`` after the first such place gives the same answer in one pass.
    """
    opening = F.regexp_extract(code, r"(?s)<\w(.*)$", 1).contains(">")
    comment = F.btrim(code, F.lit(WS_CHARS)).startswith("<!--")
    return code.contains("<") & (opening | code.rlike(r"</\w+>")) & ~comment


def dialect_by_extension(path: Column) -> Column:
    """The dialect an extension settles, else null."""
    ext = file_extension(path)
    return F.when(ext.isin(*TYPED_EXTENSIONS), "typescript").when(ext == "jsx", "babel")


def oversize_message(code: Column, max_size: int = MAX_UNIT_SIZE) -> Column:
    """What is wrong with a text over the size limit, else null; fits a step of a chain."""
    mb = 1024 * 1024
    # fixed value: the sentence
    return F.when(F.length(code) > max_size, F.concat(
        F.lit("Input code too large: "),
        F.floor(F.length(code) / F.lit(float(mb)) + 0.5).cast("string"),
        F.lit(f"MB (max: {int(max_size / mb + 0.5)}MB)"),
    ))


# What may be an escape, and what is one.
MAYBE_ESCAPE = r"\\[a-zA-Z][a-zA-Z0-9_]+"
GOOD_ESCAPE = r"^\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4})$"


def bad_escapes(code: Column) -> Column:
    """Backslash sequences of two or more word characters that are no valid escape."""
    found = F.regexp_extract_all(code, F.lit(MAYBE_ESCAPE), F.lit(0))
    return F.filter(found, lambda m: ~m.rlike(GOOD_ESCAPE))


def has_bad_escape(code: Column) -> Column:
    return F.size(bad_escapes(code)) > 0


def guard_reserved(name: Column) -> Column:
    return F.when(name.isin(*RESERVED), F.concat(name, F.lit("$"))).otherwise(name)


def _contains_any(message: Column, parts: tuple[str, ...]) -> Column:
    low = F.lower(message)
    hit = low.contains(parts[0])
    for p in parts[1:]:
        hit = hit | low.contains(p)
    return F.coalesce(hit, F.lit(False))


def is_non_retryable(message: Column) -> Column:
    return _contains_any(message, NON_RETRYABLE)


def is_retryable(status: Column, message: Column) -> Column:
    by_status = F.coalesce((status == 429) | (status >= 500), F.lit(False))
    return by_status | _contains_any(message, RETRYABLE)


# Providers, the models each offers, and the texts of the checks.
PROVIDERS = ("anthropic", "openai", "azure", "ollama")
CLOUD_PROVIDERS = ("anthropic", "openai", "azure")
OFFERED_MODELS = {
    "anthropic": (
        "claude-3-5-sonnet-20241022", "claude-3-5-haiku-20241022", "claude-3-opus-20240229",
        "claude-3-sonnet-20240229", "claude-3-haiku-20240307",
    ),
    "openai": ("gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "gpt-4", "gpt-3.5-turbo"),
    "azure": ("gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "gpt-4", "gpt-3.5-turbo"),
    "ollama": (
        "llama3:8b", "llama3:70b", "codellama:13b", "codellama:34b", "mistral:7b",
        "deepseek-coder:6.7b",
    ),
}
MSG_TEMPERATURE = "Temperature must be between 0 and 2"
MSG_MAX_TOKENS = "Max tokens must be between 1 and 200000"
MSG_AZURE_URL = "Azure provider requires baseUrl (Azure endpoint)"
WARN_OLLAMA_URL = "Ollama provider should specify baseUrl (defaults to http://localhost:11434)"
WARN_TEMPERATURE = "High temperature (>1.0) may produce inconsistent results"
WARN_MAX_TOKENS = "Very high token limit may increase costs significantly"


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def setting_errors(
    provider: Column, model: Column, api_key: Column, base_url: Column,
    temperature: Column, max_tokens: Column,
) -> Column:
    """array<string> of reasons why request settings cannot be used, in check order."""
    known = provider.isin(*PROVIDERS)
    offered = F.lit(False)
    for name, models in OFFERED_MODELS.items():
        offered = offered | ((provider == name) & model.isin(*models))
    return F.array_compact(F.array(
        F.when(~known, F.concat(F.lit("Unsupported provider: "), provider)),
        F.when(known & ~offered, F.concat(
            F.lit("Model '"), model, F.lit("' not available for "), provider)),
        F.when(provider.isin(*CLOUD_PROVIDERS) & _blank(api_key),
               F.concat(F.lit("API key required for "), provider)),
        F.when((provider == "azure") & _blank(base_url), MSG_AZURE_URL),
        F.when((temperature < 0) | (temperature > 2), MSG_TEMPERATURE),
        F.when((max_tokens < 1) | (max_tokens > 200000), MSG_MAX_TOKENS),
    ))


def setting_warnings(
    provider: Column, base_url: Column, temperature: Column, max_tokens: Column
) -> Column:
    return F.array_compact(F.array(
        F.when((provider == "ollama") & _blank(base_url), WARN_OLLAMA_URL),
        F.when(temperature > 1.0, WARN_TEMPERATURE),
        F.when(max_tokens > 100000, WARN_MAX_TOKENS),
    ))


# Limits of the workload classes.
CHUNKING_ABOVE = 100_000
CHUNK_CAP = 50_000
CHUNK_OVERLAP = 1_000
COMPLEX_ABOVE = 50


def workload(size: Column, complexity: Column, tags: Column) -> Column:
    """struct<strategy, profile, chunk_size, overlap, reason> for one unit."""

    def plan(strategy: str, profile: str, reason: str,
             chunk: Column | None = None, overlap: int | None = None) -> Column:
        return F.struct(
            F.lit(strategy).alias("strategy"),
            F.lit(profile).alias("profile"),
            (chunk if chunk is not None else F.lit(None)).cast("long").alias("chunk_size"),
            F.lit(overlap).cast("long").alias("overlap"),
            F.lit(reason).alias("reason"),
        )

    cap = F.least(F.lit(CHUNK_CAP).cast("long"), F.floor(size / F.lit(4.0)))
    return (
        F.when(size > CHUNKING_ABOVE,
               plan("chunking", "chunks", "Large file size detected", cap, CHUNK_OVERLAP))
        .when(complexity > COMPLEX_ABOVE,
              plan("preprocessing", "conditionals", "High code complexity detected"))
        .when(F.array_contains(tags, "react"),
              plan("preprocessing", "react", "React framework detected"))
        .otherwise(plan("preprocessing", "cleanup", "Default optimizations"))
    )
