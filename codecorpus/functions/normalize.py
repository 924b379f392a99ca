"""Lexical text normalisation. For fingerprints and comparison, not for rewriting programs:
collapsing white space also joins ``//`` comment lines with code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, WS_CHARS


def normalize_whitespace(code: Column) -> Column:
    one_blank = F.regexp_replace(code, WS + "+", " ")
    return F.btrim(F.regexp_replace(one_blank, rf";{WS}*;", ";"), F.lit(WS_CHARS))


def fold_conditionals(code: Column) -> Column:
    """Fold constant conditions, in order. Opt-in: the two ternary rules drop the condition's
    operator only, which does not keep the meaning of every expression."""
    out = F.regexp_replace(code, rf"if{WS}*\({WS}*true{WS}*\){WS}*\{{([^}}]*)\}}", "$1")
    out = F.regexp_replace(out, rf"if{WS}*\({WS}*false{WS}*\){WS}*\{{[^}}]*\}}", "")
    out = F.regexp_replace(out, rf"\?{WS}*true{WS}*:{WS}*false", "")
    return F.regexp_replace(out, rf"\?{WS}*false{WS}*:{WS}*true", "!")


def keep_return_line(code: Column) -> Column:
    """The rule that keeps the first line of each ``return`` that further lines follow.

    It cuts what stands between that line and a later line break. But it already holds at the first
    line break that is not right before a brace, where nothing stands between, so it leaves every
    text as it is, and no text is searched for it. `drop_after_return` is the rule that cuts.
    """
    return code


def drop_after_return(code: Column) -> Column:
    """Drop the text between a ``return …;`` and the brace that closes its block.

    Opt-in and lexical: a conditional ``return`` without a block of its own also cuts."""
    return F.regexp_replace(code, r"(return(?:[ \t(][^;{}\n]*)?;)[^{}]*\}", "$1}")
