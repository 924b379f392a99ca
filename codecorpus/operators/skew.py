"""Joining rows to a table with unique keys when a few keys hold many of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with at least this share of all rows is hot, so there are at most 1 / share of them.
HOT_SHARE = 0.01


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys with at least `share` of all rows: 1 / share rows at most.

    Only the key column is read, and counts are combined per task before the shuffle.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.filter((F.col("n") >= total * F.lit(share)) & (F.col("n") > 1)).select(key)


def join_unique(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "left", share: float = HOT_SHARE
) -> DataFrame:
    """`rows` joined to `lookup`, which has unique keys; how is inner, left or left_anti.

    Rows of hot keys stay where they are: their few entries are broadcast, a table whose
    number of rows is bounded by the share. All other rows are joined by a shuffle on the
    key. Which keys are hot only decides the way, never the result, as long as `rows` gives the
    same rows each time it is read: a table, or columns computed from one.
    """
    hot = F.broadcast(hot_keys(rows, key, share))
    hot_entries = F.broadcast(lookup.join(hot, key, "left_semi"))
    spread = rows.join(hot, key, "left_semi").join(hot_entries, key, how)
    shuffled = rows.join(hot, key, "left_anti").join(lookup, key, how)
    return spread.unionByName(shuffled)
