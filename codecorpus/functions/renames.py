"""Rename parsing and application for one text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import bad_escapes
from .text import WS, let, literal_replacement, whole_word_pattern

# Fixed values.
DEFAULT_CONFIDENCE = 0.5
FALLBACK_REASON = "Extracted from text response"
LOW_MEAN = 0.6
DEFAULT_THRESHOLD = 0.3

# Sentence shapes that name a rename, in the order their hits are listed. A
# word run is taken whole (possessive, from its start), so long runs cost one pass.
FALLBACK_SHAPES = (
    rf"(?i)rename{WS}+(\w++){WS}+to{WS}+(\w+)",
    rf"(?<!\w)(\w++){WS}*->{WS}*(\w+)",
    rf"(?<!\w)(\w++){WS}*=>{WS}*(\w+)",
)


def text_fallback(text: Column) -> Column:
    """array<struct<original_name, suggested_name>> found in free text, all of them."""

    def found(pattern: str, sign: str | None) -> Column:
        pairs = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda m: F.struct(
                F.regexp_extract(m, pattern, 1).alias("original_name"),
                F.regexp_extract(m, pattern, 2).alias("suggested_name"),
            ),
        )
        if sign is None:
            return pairs
        none = F.array().cast("array<struct<original_name:string,suggested_name:string>>")
        return F.when(text.contains(sign), pairs).otherwise(none)

    hits = [found(p, sign) for p, sign in zip(FALLBACK_SHAPES, (None, "->", "=>"), strict=True)]
    return F.concat(*hits)


def repair_trailing_comma(json_text: Column) -> Column:
    """The first ``},]`` loses its comma; later ones stay."""
    return F.regexp_replace(json_text, rf"(?s)^(.*?)\}},{WS}*\]", "$1}]")


def pair_up(names: Column, new_names: Column) -> Column:
    """array<struct<name, new_name>> of two parallel arrays, cut to the shorter one."""
    n = F.least(F.size(names), F.size(new_names))
    return F.arrays_zip(
        F.slice(names, F.lit(1), n).alias("name"), F.slice(new_names, F.lit(1), n).alias("new_name")
    )


def apply_in_sequence(code: Column, renames: Column) -> Column:
    """Whole-word replacement one rename after the other, longest original first.

    `renames` is array<struct<original_name, suggested_name>>, already in that order, so a
    later rename may hit a name that an earlier one produced. One-letter names are left
    alone, and a rename that would add a broken escape sequence is passed over.
    """

    def changed(acc: Column, r: Column) -> Column:
        new = F.regexp_replace(
            acc, whole_word_pattern(r.original_name), literal_replacement(r.suggested_name)
        )
        return let(new, lambda n: F.when(
            F.size(bad_escapes(n)) > F.size(bad_escapes(acc)), acc).otherwise(n))

    def step(acc: Column, r: Column) -> Column:
        may_apply = (F.length(r.original_name) > 1) & F.contains(acc, r.original_name)
        return F.when(may_apply, changed(acc, r)).otherwise(acc)

    return F.aggregate(renames, code, step)


def longest_first(renames: Column) -> Column:
    """Sort array<struct<original_name, …>> by name length descending, then by name."""
    return F.array_sort(
        renames,
        lambda a, b: F.when(F.length(a.original_name) > F.length(b.original_name), -1)
        .when(F.length(a.original_name) < F.length(b.original_name), 1)
        .when(a.original_name < b.original_name, -1)
        .when(a.original_name > b.original_name, 1)
        .otherwise(0),
    )


def percent_text(share: Column) -> Column:
    """A share as percent with one decimal, as text."""
    tenths = F.floor(share * 1000 + 0.5).cast("long")
    return F.concat_ws(".", F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string"))


def quality_warnings(excluded: Column, mean: Column, threshold: float) -> Column:
    limit = f"{threshold * 100:g}"
    return F.array_compact(F.array(
        F.when(excluded > 0, F.concat(
            excluded.cast("string"),
            F.lit(f" suggestions excluded due to low confidence (< {limit}%)"))),
        F.when(mean < LOW_MEAN, F.concat(
            F.lit("Average confidence is low ("), percent_text(mean),
            F.lit("%), consider manual review"))),
    ))
