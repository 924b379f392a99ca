"""Classification, routing of bad input and checks over tables of units or requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import features as ft
from ..functions.text import collapse_ws


def obfuscation_indicators(units: DataFrame) -> DataFrame:
    """The six signs per unit, their number, their names, and the verdict."""
    flags = units.select(
        "unit_id", "path", "kind", "code",
        *[c.alias(n) for n, c in cl.indicators(F.col("code")).items()],
    )
    active = F.array_compact(F.array(*[F.when(F.col(n), n) for n in cl.INDICATORS]))
    named = flags.withColumn("active", active)
    return named.withColumns({
        "n_indicators": F.size("active").cast("long"),
        "needs_processing": F.size("active") >= cl.POSITIVE_AT,
    })


def split_readable(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units that need work, units that are readable already)."""
    signs = [c.cast("int") for c in cl.indicators(F.col("code")).values()]
    needs = sum(signs[1:], signs[0]) >= cl.POSITIVE_AT
    return units.filter(needs), units.filter(~needs)


def split_oversize(
    units: DataFrame, max_size: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(all units, flagged by `oversize`; error rows for those over the limit).

    Without a limit no unit is over it. Callers that must not go on with large units filter."""
    too_long = F.lit(False) if max_size is None else F.length("code") > max_size
    errors = units.filter(too_long).select(
        "unit_id",
        # fixed values: code and step of the error row
        F.lit("WEBCRACK_FAILED").alias("code"),
        cl.oversize_message(F.col("code"), max_size or cl.MAX_UNIT_SIZE).alias("message"),
        F.lit("webcrack").alias("step"), F.lit(True).alias("recoverable"),
    )
    return units.withColumn("oversize", too_long), errors


def detect_dialect(units: DataFrame) -> DataFrame:
    """Dialect of each unit and the rule that told it.

    The text is only searched where the extension leaves it open, and once for both columns.
    """
    known = cl.file_extension(F.col("path")).isin(*cl.DECIDING_EXTENSIONS)
    facts = units.select(
        "unit_id", "path",
        F.when(~known, cl.has_typed_syntax(F.col("code"))).alias("typed"),
        F.when(~known, cl.has_markup_syntax(F.col("code"))).alias("markup"),
    )
    by_path = cl.dialect_by_extension(F.col("path"))
    return facts.select(
        "unit_id", "path",
        F.coalesce(by_path, F.when(F.col("typed"), "typescript").otherwise("babel")).alias("dialect"),
        F.when(by_path.isNotNull(), "extension").when(F.col("typed"), "typed_syntax")
        .when(F.col("markup"), "markup_syntax").otherwise("default").alias("rule"),
    )


def filter_confident(suggestions: DataFrame, threshold: float = 0.3) -> DataFrame:
    return suggestions.filter(F.col("confidence") >= threshold)


def cosmetic_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether two versions of a unit differ in white space only.

    Digests are compared, so the join moves 64 bytes per text instead of the text.
    """
    def digests(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "unit_id", F.sha2("code", 256).alias(f"{prefix}_text"),
            F.sha2(collapse_ws(F.col("code")), 256).alias(f"{prefix}_words"))

    return digests(before, "b").join(digests(after, "a"), "unit_id").select(
        "unit_id",
        (F.col("b_text") == F.col("a_text")).alias("identical"),
        (F.col("b_words") == F.col("a_words")).alias("cosmetic_only"),
    )


def classify_errors(errors: DataFrame) -> DataFrame:
    """Adds whether a failed call must not, or may, be tried again (columns status, message)."""
    return errors.withColumns({
        "non_retryable": cl.is_non_retryable(F.col("message")),
        "retryable": cl.is_retryable(F.col("status"), F.col("message")),
    })


def validate_settings(settings: DataFrame) -> DataFrame:
    """Adds errors, warnings and the verdict to request settings."""
    c = F.col
    return settings.withColumns({
        "errors": cl.setting_errors(
            c("provider"), c("model"), c("api_key"), c("base_url"),
            c("temperature"), c("max_tokens")),
        "warnings": cl.setting_warnings(
            c("provider"), c("base_url"), c("temperature"), c("max_tokens")),
    }).withColumn("valid", F.size("errors") == 0)


def workload_classes(units: DataFrame) -> DataFrame:
    """Strategy of each unit from its size, its complexity and its framework tags."""
    code = F.col("code")
    facts = units.select(
        "unit_id",
        ft.n_chars(code).alias("size"),
        ft.branch_count(code).alias("branches"),
        ft.brace_depth(code).alias("depth"),
        ft.framework_tags(code).alias("tags"),
    )
    plan = cl.workload(F.col("size"), F.col("branches") + F.col("depth"), F.col("tags"))
    return facts.select("unit_id", "size", plan.alias("w")).select("unit_id", "size", "w.*")
