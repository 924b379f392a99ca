"""Request texts. The wording is ours; the facts in it are computed per unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import complexity_label, function_words, line_count

SYSTEM_PROMPT = (
    "You are an experienced JavaScript developer who makes compressed scripts readable. "
    "Propose variable and function names that say what each one is for: camelCase for "
    "variables and functions, PascalCase for classes. Avoid empty names such as temp or "
    "data. Answer with a list of renames and confidence scores."
)

# What each provider is told about the form of the answer.
ANSWER_FORM = {
    "anthropic": "Answer through the suggest_renames tool.",
    "openai": "Answer by calling the suggest_renames function.",
    "azure": "Answer by calling the suggest_renames function.",
    "ollama": (
        'Answer with JSON only: {"suggestions": [{"originalName", "suggestedName", '
        '"confidence", "reasoning", "type"}]}.'
    ),
}


def user_prompt(code: Column) -> Column:
    lines = line_count(code)
    return F.concat(
        F.lit("Suggest better names for this script.\n\nLines: "), lines.cast("string"),
        F.lit("\nCharacters: "), F.length(code).cast("string"),
        F.lit("\nEstimated complexity: "), complexity_label(lines, function_words(code)),
        F.lit("\n\n```javascript\n"), code, F.lit("\n```\n"),
    )


def full_prompt(code: Column, provider: Column) -> Column:
    form = F.lit("")
    for name, text in ANSWER_FORM.items():
        form = F.when(provider == name, F.lit(text)).otherwise(form)
    return F.concat(F.lit(SYSTEM_PROMPT + "\n\n"), user_prompt(code), form)
