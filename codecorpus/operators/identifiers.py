"""Identifier inventories, term counts and whole-word replacement.

Units are tokenised whole: cutting a text first would split names at the cuts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_matches, identifiers, let, whole_word_regex, whole_words
from .rows import explode_once


def unit_identifiers(units: DataFrame) -> DataFrame:
    """Distinct identifiers of each unit. No shuffle: a unit is one row."""
    found = F.array_distinct(identifiers(F.col("code")))
    return explode_once(units, "unit_id", array=found, name="identifier")


def identifier_inventory(units: DataFrame) -> DataFrame:
    """Occurrences and units per identifier over the corpus.

    Distinct names are taken inside the row, which turns the distinct count of units into a
    count of rows. Each unit gives two lists, all its names and its distinct names; counts are
    combined per task before the shuffle, so a name that is everywhere arrives as one row
    per task.
    """
    def lists(names: Column) -> Column:
        return F.array(
            F.struct(F.lit(False).alias("once"), names.alias("names")),
            F.struct(F.lit(True).alias("once"), F.array_distinct(names).alias("names")),
        )

    both = explode_once(units, array=let(identifiers(F.col("code")), lists), name="l")
    rows = explode_once(
        both.select("l.once", "l.names"), "once", array=F.col("names"), name="identifier")
    return rows.groupBy("identifier").agg(
        F.count_if(~F.col("once")).alias("occurrences"),
        F.count_if(F.col("once")).alias("units"),
    )


def approx_identifier_count(units: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Estimated number of distinct identifiers per kind of unit, by a fixed-size sketch."""
    toks = explode_once(units, "kind", array=identifiers(F.col("code")), name="identifier")
    return toks.groupBy("kind").agg(
        F.approx_count_distinct("identifier", rsd).cast("long").alias("identifiers")
    )


def _run_length(ordered: Column, value: Column) -> Column:
    """How often a value stands in a sorted array: from its first place to its last."""
    return F.size(ordered) - F.array_position(F.reverse(ordered), value) - F.array_position(ordered, value) + 2


def _term_hits(code: Column, terms: Sequence[str]) -> Column:
    """array<struct<term, n>> with one zero row per term.

    A term of word characters occurs as a whole word exactly where a maximal word run equals
    it, so all such terms share one pass over the text, and counts are made in the row.
    Other terms are matched one by one, where the text has them.
    """
    words = [t for t in terms if re.fullmatch(r"\w+", t, re.ASCII)]
    others = [t for t in terms if t not in set(words)]

    def row(term: Column, n: Column) -> Column:
        return F.struct(term.alias("term"), n.cast("long").alias("n"))

    parts = [F.array(*[row(F.lit(t), F.lit(0)) for t in terms])]
    if words:
        hits = F.regexp_extract_all(code, F.lit(whole_words(*words)), F.lit(0))
        parts.append(let(F.array_sort(hits), lambda found: F.transform(
            F.array_distinct(found), lambda t: row(t, _run_length(found, t)))))
    if others:
        parts.append(F.array(*[
            row(F.lit(t), F.when(code.contains(t), count_matches(code, whole_word_regex(t)))
                .otherwise(0))
            for t in others
        ]))
    return F.concat(*parts)


def count_terms(units: DataFrame, terms: Iterable[str], per_unit: bool = False) -> DataFrame:
    """Whole-word occurrences of the given terms, absent ones with zero."""
    wanted = list(dict.fromkeys(t for t in terms if t))
    keys = ["unit_id", "term"] if per_unit else ["term"]
    hits = explode_once(units, "unit_id", array=_term_hits(F.col("code"), wanted), name="h")
    return hits.select("unit_id", "h.term", "h.n").groupBy(*keys).agg(
        F.sum("n").cast("long").alias("n"))


def _replacement(old: str, new: str) -> Callable[[Column], Column]:
    literal = new.replace("\\", "\\\\").replace("$", "\\$")
    return lambda c: F.when(
        c.contains(old), F.regexp_replace(c, whole_word_regex(old), literal)).otherwise(c)


def replace_terms(units: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Whole-word replacement of each pair in order; the replacement is taken literally."""
    code = F.col("code")
    for old, new in pairs:
        code = let(code, _replacement(old, new))
    return units.withColumn("code", code)
