"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(
    df: DataFrame, *keep: str, array: Column, name: str, position: str | None = None
) -> DataFrame:
    """One row per element of `array`, with the kept columns.

    An inner explode makes the optimizer add a filter on the size of the array, and with it
    a second evaluation of the expression that builds it. The outer form does not; the one
    row it gives for an empty array is dropped afterwards.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("_pos", name)).filter(
        F.col("_pos").isNotNull())
    if position is None:
        return rows.drop("_pos")
    return rows.select(*keep, F.col("_pos").cast("long").alias(position), name)
