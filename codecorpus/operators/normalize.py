"""Text normalisation and preprocessing by workload class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import normalize as nm
from ..functions.classify import workload


def normalize_whitespace(units: DataFrame) -> DataFrame:
    return units.withColumn("code", nm.normalize_whitespace(F.col("code")))


def fold_conditionals(units: DataFrame) -> DataFrame:
    return units.withColumn("code", nm.fold_conditionals(F.col("code")))


def keep_return_line(units: DataFrame) -> DataFrame:
    return units.withColumn("code", nm.keep_return_line(F.col("code")))


def drop_after_return(units: DataFrame) -> DataFrame:
    return units.withColumn("code", nm.drop_after_return(F.col("code")))


def whitespace_fingerprint(units: DataFrame) -> DataFrame:
    """Hash of the normalised text: units that differ in layout only share it."""
    return units.select(
        "unit_id", F.sha2(nm.normalize_whitespace(F.col("code")), 256).alias("fingerprint")
    )


def preprocess(units: DataFrame) -> DataFrame:
    """Apply the preprocessing of each unit's workload class; units to be chunked are cleaned whole."""
    code = F.col("code")
    plan = workload(
        ft.n_chars(code), ft.cyclomatic_score(code), ft.framework_tags(code)
    )
    classed = units.withColumn("w", plan)
    cleaned = nm.normalize_whitespace(code)
    return classed.select(
        "unit_id", F.col("w.profile").alias("profile"),
        F.when(F.col("w.profile").isin("cleanup", "chunks"), cleaned)
        .when(F.col("w.profile") == "conditionals", nm.fold_conditionals(code))
        .otherwise(code).alias("code"),
    )
