"""Statistics, features and version comparison over tables of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions.text import let
from .rows import explode_once

COMPARISONS = {
    "unpack": ft.unpack_metrics,
    "transform": ft.transform_metrics,
    "format": ft.format_metrics,
}


def unit_statistics(units: DataFrame) -> DataFrame:
    """Lines, characters, tokens, functions, variables and the 0-5 complexity of each unit.

    The text is read once per pattern in a single projection; the bands come in a second
    one, so that no pattern runs again for each comparison.
    """
    counts = units.select(
        "unit_id", "kind",
        ft.n_chars(F.col("code")).alias("n_chars"),
        ft.line_count(F.col("code")).alias("lines"),
        ft.token_estimate(F.col("code")).alias("tokens"),
        ft.function_count(F.col("code")).alias("functions"),
        ft.variable_count(F.col("code")).alias("variables"),
    )
    return counts.withColumn(
        "complexity", ft.complexity_score(F.col("lines"), F.col("functions"))
    )


def structure_statistics(units: DataFrame) -> DataFrame:
    """Extended function count, brace depth, branches and the three complexity views."""
    code = F.col("code")
    counts = units.select(
        "unit_id",
        ft.line_count(code).alias("lines"),
        ft.function_count_full(code).alias("functions"),
        ft.function_words(code).alias("function_words"),
        ft.brace_depth(code).alias("depth"),
        ft.branch_count(code).alias("branches"),
    )
    return counts.withColumns({
        "complexity": ft.complexity_score_nested(
            F.col("lines"), F.col("functions"), F.col("depth")),
        "label": ft.complexity_label(F.col("lines"), F.col("function_words")),
        "cyclomatic": F.col("branches") + F.col("depth"),
    })


def framework_tags(units: DataFrame) -> DataFrame:
    return units.select("unit_id", ft.framework_tags(F.col("code")).alias("tags"))


def dependency_rows(units: DataFrame) -> DataFrame:
    """One row per dependency statement, in order."""
    rows = explode_once(
        units, "unit_id", array=ft.dependencies(F.col("code")), name="dep", position="ordinal")
    return rows.select("unit_id", "ordinal", "dep.statement", "dep.module")


def dependency_counts(units: DataFrame) -> DataFrame:
    """Statements and units per module.

    Each unit is one row, so it can flag the first mention of a module itself. That leaves
    two plain sums, combined before the only shuffle, instead of a distinct count.
    """
    modules = F.transform(ft.dependencies(F.col("code")), lambda d: d.module)
    mentions = explode_once(units, name="d", array=let(modules, lambda m: F.concat(
        F.transform(m, lambda x: F.struct(
            x.alias("module"), F.lit(1).alias("s"), F.lit(0).alias("u"))),
        F.transform(F.array_distinct(m), lambda x: F.struct(
            x.alias("module"), F.lit(0).alias("s"), F.lit(1).alias("u"))),
    )))
    return mentions.groupBy(F.col("d.module").alias("module")).agg(
        F.sum("d.s").cast("long").alias("statements"),
        F.sum("d.u").cast("long").alias("units"),
    )


def compare_versions(before: DataFrame, after: DataFrame, how: str) -> DataFrame:
    """Metrics of two versions of each unit; `how` is unpack, transform or format.

    Both texts are reduced to their sizes before the join, so no text is shuffled.
    """
    joined = before.select("unit_id", ft.sizes(F.col("code")).alias("b")).join(
        after.select("unit_id", ft.sizes(F.col("code")).alias("a")), "unit_id"
    )
    metrics = COMPARISONS[how](F.col("b"), F.col("a"))
    return joined.select("unit_id", *[c.alias(n) for n, c in metrics.items()])


def idiom_counts(units: DataFrame) -> DataFrame:
    counts = ft.idiom_counts(F.col("code"))
    return units.select("unit_id", *[c.alias(n) for n, c in counts.items()])


def idiom_prevalence(units: DataFrame) -> DataFrame:
    """Occurrences of each idiom and units that show it, over the corpus.

    Aggregated wide first, then turned into rows: the shuffle carries one row per task.
    """
    counts = idiom_counts(units)
    aggs = []
    for name in ft.IDIOMS:
        aggs.append(F.sum(name).cast("long").alias(f"{name}_n"))
        aggs.append(F.count_if(F.col(name) > 0).cast("long").alias(f"{name}_u"))
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("idiom"),
            F.coalesce(F.col(f"{name}_n"), F.lit(0)).alias("occurrences"),
            F.col(f"{name}_u").alias("units"),
        )
        for name in ft.IDIOMS
    ])
    return counts.agg(*aggs).select(F.inline(rows))
