"""Statistics and features of one source unit, as columns over its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, count_char, count_matches, count_near, js_round, ratio, whole_words

# The shapes counted as functions and declarations. Where a shape starts with
# a run of word characters one of them is enough, the count is the same and stays linear.
NAMED_FUNCTION = rf"function{WS}+\w+"
KEYED_FUNCTION = rf"\w{WS}*:{WS}*function"
ARROW_BLOCK = rf"=>{WS}*\{{"
ASSIGNED_FUNCTION = rf"\w{WS}*={WS}*function"
DECLARATION = rf"(?<!\w)(?:var|let|const){WS}+\w+"
BRANCH_KEYWORD = whole_words("if", "while", "for", "switch")
REQUIRE = r"""require\(['"`]([^'"`]+)['"`]\)"""
IMPORT = rf"""import[^\n\r]*from{WS}+['"`]([^'"`]+)['"`]"""

# Framework tags in output order, with the words that reveal them.
FRAMEWORKS = (
    ("jquery", ("jQuery", "$")),
    ("react", ("React", "jsx")),
    ("vue", ("Vue",)),
    ("angular", ("angular",)),
    ("webpack", ("webpack", "__webpack")),
)


def n_chars(code: Column) -> Column:
    return F.length(code).cast("long")


def line_count(code: Column) -> Column:
    return count_char(code, "\n") + F.lit(1)


def token_estimate(code: Column) -> Column:
    """One token per four characters, rounded up."""
    return F.ceil(F.length(code) / F.lit(4.0)).cast("long")


def function_count(code: Column) -> Column:
    return (
        count_near(code, "function", NAMED_FUNCTION)
        + count_near(code, "function", KEYED_FUNCTION)
        + count_near(code, "=>", ARROW_BLOCK)
    )


def function_count_full(code: Column) -> Column:
    """Adds functions assigned to a name. ``x = function y`` counts twice by design."""
    return function_count(code) + count_near(code, "function", ASSIGNED_FUNCTION)


def variable_count(code: Column) -> Column:
    return count_matches(code, DECLARATION)


def _size_band(lines: Column) -> Column:
    return F.when(lines > 1000, 3).when(lines > 500, 2).when(lines > 100, 1).otherwise(0)


def _function_band(functions: Column) -> Column:
    return F.when(functions > 50, 2).when(functions > 20, 1).otherwise(0)


def _depth_band(depth: Column) -> Column:
    return F.when(depth > 10, 2).when(depth > 5, 1).otherwise(0)


def complexity_score(lines: Column, functions: Column) -> Column:
    """0 to 5 from size and function bands."""
    return (_size_band(lines) + _function_band(functions)).cast("long")


def complexity_score_nested(lines: Column, functions: Column, depth: Column) -> Column:
    """0 to 7: the nesting band on top."""
    return (_size_band(lines) + _function_band(functions) + _depth_band(depth)).cast("long")


def brace_depth(code: Column) -> Column:
    """Deepest nesting of braces. Only braces are kept before folding, so arrays stay short."""
    braces = F.regexp_replace(code, r"[^{}]+", "")
    steps = F.filter(F.split(braces, ""), lambda b: b != "")
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("cur"), F.lit(0).alias("top")),
        lambda a, b: F.struct(
            (a.cur + F.when(b == "{", 1).otherwise(-1)).alias("cur"),
            F.greatest(a.top, a.cur + F.when(b == "{", 1).otherwise(-1)).alias("top"),
        ),
        lambda a: a.top,
    ).cast("long")


def complexity_label(lines: Column, function_words: Column) -> Column:
    return (
        F.when((lines > 1000) | (function_words > 50), "high")
        .when((lines > 300) | (function_words > 15), "medium")
        .otherwise("low")
    )


def function_words(code: Column) -> Column:
    """Plain substring count of the word ``function``."""
    return count_near(code, "function", "function")


def branch_count(code: Column) -> Column:
    return count_matches(code, BRANCH_KEYWORD)


def cyclomatic_score(code: Column) -> Column:
    return branch_count(code) + brace_depth(code)


def framework_tags(code: Column) -> Column:
    def has(words: tuple[str, ...]) -> Column:
        hit = code.contains(words[0])
        for w in words[1:]:
            hit = hit | code.contains(w)
        return hit

    return F.array_compact(F.array(*[F.when(has(w), tag) for tag, w in FRAMEWORKS]))


def dependencies(code: Column) -> Column:
    """array<struct<statement, module>>: required modules first, then imported ones."""

    none = F.array().cast("array<struct<statement:string,module:string>>")

    def found(word: str, pattern: str) -> Column:
        rows = F.transform(
            F.regexp_extract_all(code, F.lit(pattern), F.lit(0)),
            lambda s: F.struct(
                s.alias("statement"), F.regexp_extract(s, pattern, 1).alias("module")),
        )
        return F.when(code.contains(word), rows).otherwise(none)

    return F.concat(found("require(", REQUIRE), found("import", IMPORT))


def sizes(code: Column) -> Column:
    """struct<lines, chars>: all that the version metrics need to know of a text."""
    return F.struct(line_count(code).alias("lines"), n_chars(code).alias("chars"))


def _mean_line_length(size: Column) -> Column:
    return ratio(size.chars - size.lines + 1, size.lines)


def unpack_metrics(before: Column, after: Column) -> dict[str, Column]:
    """Line and size growth in percent, mean line lengths; null growth for empty input."""
    return {
        "original_lines": before.lines,
        "processed_lines": after.lines,
        "line_increase": js_round(ratio(after.lines - before.lines, before.lines) * 100),
        "original_avg_line_length": js_round(_mean_line_length(before)),
        "processed_avg_line_length": js_round(_mean_line_length(after)),
        "size_increase": js_round(ratio(after.chars - before.chars, before.chars) * 100),
    }


def transform_metrics(before: Column, after: Column) -> dict[str, Column]:
    """Lines added, size change, length ratio; null ratio for empty input."""
    return {
        "lines_added": after.lines - before.lines,
        "characters_changed": F.abs(after.chars - before.chars),
        "transformation_ratio": ratio(after.chars, before.chars),
    }


def format_metrics(before: Column, after: Column) -> dict[str, Column]:
    """Line and length differences, ratio 1 for empty input."""
    return {
        "original_lines": before.lines,
        "formatted_lines": after.lines,
        "lines_difference": after.lines - before.lines,
        "original_length": before.chars,
        "formatted_length": after.chars,
        "length_difference": after.chars - before.chars,
        "compression_ratio": F.when(before.chars > 0, ratio(after.chars, before.chars))
        .otherwise(F.lit(1.0)),
    }


# Minifier idioms that are measured, not rewritten.
IDIOMS = {
    "void_zero": whole_words("void 0"),
    "literal_first": (
        rf"""(?:(?<!\w)(?:[0-9]+|null|true|false)|"[^"\n]*"){WS}*"""
        rf"""(?:===|!==|==|!=|<=|>=|<|>){WS}*[A-Za-z_$]"""
    ),
    "exponent_literal": r"(?<!\w)[0-9]+(?:\.[0-9]+)?e[0-9]+(?!\w)",
    "compare_boolean": rf"(?:^|[^!=<>])===?{WS}*(?:true|false)(?!\w)",
    "double_negation": r"!![A-Za-z_$(]",
}


IDIOM_NEEDLES = {"void_zero": "void 0", "compare_boolean": "==", "double_negation": "!!"}


def idiom_counts(code: Column) -> dict[str, Column]:
    return {
        name: count_near(code, IDIOM_NEEDLES[name], p) if name in IDIOM_NEEDLES
        else count_matches(code, p)
        for name, p in IDIOMS.items()
    }
