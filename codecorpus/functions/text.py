"""Text helpers shared by every operator.

Script engines treat ``\\b`` and ``\\w`` as ASCII. Java 17 does so only for ``\\w``, so no
pattern here uses ``\\b``: each word boundary is spelled out as a look-around on ``\\w``.
White space is the ASCII class ``WS``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f]"
WS_CHARS = " \t\n\r\f"

# A maximal ASCII identifier between ASCII word boundaries. The two branches are the two
# characters an identifier can start with after a boundary: a word character, or "$" glued
# to a word character. Ending on a word character is what the closing boundary demands.
IDENT = (
    r"(?<!\w)[A-Za-z_](?:[A-Za-z0-9_$]*\w)?"
    r"|(?<=\w)\$[A-Za-z0-9_$]*\w"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it as often as `body` likes.

    A column used inside a lambda is an expression that runs again for every element; bound
    this way it is a value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_words(*words: str) -> str:
    """Pattern for any of the given plain words between word boundaries."""
    return r"(?<!\w)(?:" + "|".join(words) + r")(?!\w)"


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def count_near(text: Column, needle: str, pattern: str) -> Column:
    """`count_matches` for a pattern that cannot match without `needle` in the text: a plain
    substring search spares most texts the pattern."""
    return F.when(text.contains(needle), count_matches(text, pattern)).otherwise(
        F.lit(0).cast("long"))


def matches_near(text: Column, needle: str, pattern: str) -> Column:
    """Whether `pattern`, which cannot match without `needle`, occurs in the text."""
    return text.contains(needle) & text.rlike(pattern)


def count_char(text: Column, ch: str) -> Column:
    """Occurrences of one character, by the length that its removal costs."""
    return (F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))).cast("long")


def identifiers(text: Column) -> Column:
    """All identifier occurrences in order, as an array."""
    return F.regexp_extract_all(text, F.lit(IDENT), F.lit(0))


def js_round(x: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def ratio(num: Column, den: Column) -> Column:
    """Floating division, null where the divisor is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def collapse_ws(text: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.btrim(F.regexp_replace(text, WS + "+", " "), F.lit(WS_CHARS))


# Values from which sums keep 18 decimals; smaller and larger ones are scaled by powers of two.
PLAIN_FROM, PLAIN_TO = 1e-9, 1e10


def is_plain(x: Column) -> Column:
    """Whether a decimal of 18 places holds the value to the last digit that counts."""
    size = F.abs(x.cast("double"))
    return (size == 0) | ((size >= PLAIN_FROM) & (size < PLAIN_TO))


def exact_sum(x: Column) -> Column:
    """Sum whose result does not depend on the order in which partial sums are merged.

    A floating sum changes in its last digits with the order of the shuffle blocks, so
    re-running a task could change a report. Values are added as decimals in three ranges of
    their size: with 18 places from 1e-9 to 1e10, scaled by powers of two from 1e-30 and to 1e25.
    Only what lies beyond, or is no number, is added as floating values.
    """
    v = x.cast("double")
    size = F.abs(v)
    plain = is_plain(x)
    tiny = ~plain & (size >= 1e-30) & (size < PLAIN_FROM)
    large = ~plain & (size >= PLAIN_TO) & (size < 1e25)
    none = F.lit(0.0)

    def part(chosen: Column, scale: float, kind: str) -> Column:
        return F.coalesce(F.sum(F.when(chosen, v * scale).cast(kind)).cast("double") / scale, none)

    total = (
        F.coalesce(F.sum(F.when(plain, x).cast("decimal(28,18)")).cast("double"), none)
        + part(tiny, 2.0**90, "decimal(28,6)") + part(large, 2.0**-30, "decimal(28,10)")
        + F.coalesce(F.sum(F.when(~(plain | tiny | large), v)), none)
    )
    return F.when(F.count(x) > 0, total)


def exact_mean(x: Column) -> Column:
    """Mean of the non-null values by `exact_sum`; null for an empty group."""
    return F.try_divide(exact_sum(x), F.count(x).cast("double"))


def literal_pattern(name: Column) -> Column:
    r"""A pattern that matches the text of `name` itself."""
    return F.concat(
        F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
    )


def literal_replacement(name: Column) -> Column:
    r"""A replacement that inserts the text of `name` itself: ``\`` and ``$`` are escaped."""
    return F.regexp_replace(name, r"([\\$])", r"\\$1")


def _edge(ch: Column, after: str, inside: str) -> Column:
    return F.when(ch.rlike(r"^\w$"), F.lit(after)).otherwise(F.lit(inside))


def whole_word_pattern(name: Column) -> Column:
    """Pattern for `name` between word boundaries, for names held in a column."""
    return F.concat(
        _edge(F.left(name, F.lit(1)), r"(?<!\w)", r"(?<=\w)"),
        literal_pattern(name),
        _edge(F.right(name, F.lit(1)), r"(?!\w)", r"(?=\w)"),
    )


def whole_word_regex(name: str) -> str:
    """Pattern for `name` between word boundaries, for names known when the plan is built."""
    first = r"(?<!\w)" if re.match(r"\w", name[0], re.ASCII) else r"(?<=\w)"
    last = r"(?!\w)" if re.match(r"\w", name[-1], re.ASCII) else r"(?=\w)"
    return first + r"\Q" + name.replace(r"\E", r"\E\\E\Q") + r"\E" + last
