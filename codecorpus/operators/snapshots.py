"""A response cache stored as a table of buckets, of which an upsert rewrites those it touches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders of a stored cache; an upsert of few entries touches few of them.
BUCKETS = 256


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def latest_entries(entries: DataFrame, place: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The latest entry per key; of several of one time, any one, but always the same.

    Which entry it is follows from keys, times and 64-bit hashes of whole rows alone, by sums that
    need no sort; the entries themselves meet the outcome in a hash join and are never sorted.
    Rows that are equal in all columns become one. `place` adds the columns to deal rows by; they
    follow from key, time and hash, and lie beside the entry in what is returned.
    """
    place = place or (lambda df: df)
    rows = place(entries.select("*", F.xxhash64(*entries.columns).alias("_hash")))
    by = [c for c in rows.columns if c not in (*entries.columns, "_hash")]
    narrow = rows.select("key", "created_at", "_hash")
    newest = narrow.groupBy("key").agg(F.max("created_at").alias("created_at"))
    chosen = place(narrow.join(newest, ["key", "created_at"]).groupBy("key", "created_at").agg(F.max("_hash").alias("_hash")))
    dealt, chosen = (df.repartition(*by) if by else df for df in (rows, chosen))
    # One row of `chosen` at most for each; the optimizer would move a semi join in front of the dealing.
    kept = dealt.join(chosen.hint("shuffle_hash"), [*by, "key", "created_at", "_hash"]).select(*rows.columns)
    return kept.distinct().drop("_hash")  # dealt by the columns of the join, so equal rows lie together


def write_snapshot(entries: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Stores the latest entry per key, a folder per bucket of keys. A null key is no entry."""
    _write(entries.filter("key is not null"), folder, buckets, "errorifexists")


#: Rows lie together by bucket and part, which is all that the join and the removal of equal rows ask for;
#: a task has few buckets and keeps a file open for each, so that it need not sort its rows.
_AS_DEALT = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.maxConcurrentOutputFileWriters": "64"}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def _write(entries: DataFrame, folder: str, buckets: int, mode: str) -> None:
    """Writes the latest of the entries; each entry is shuffled once.

    A bucket is dealt in parts by time and hash, so that the rows of a key that holds many do not meet in one task.
    """
    spark = entries.sparkSession
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)

    def place(df: DataFrame) -> DataFrame:
        return df.withColumns({"bucket": bucket_of(F.col("key"), buckets),
                               "_part": F.pmod(F.xxhash64("key", "created_at", "_hash"), F.lit(parts)).cast("int")})

    with _settings(spark, _AS_DEALT):
        latest_entries(entries, place).drop("_part").write.mode(mode).option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The stored entries with their bucket."""
    return spark.read.parquet(folder)


def upsert_snapshot(spark: SparkSession, folder: str, entries: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Adds entries to a stored cache, the latest per key staying; returns the buckets rewritten.

    Only buckets that `entries` fall into are read and written. They are written next to the old ones
    and take their places at the end, so a job that fails before leaves the cache as it was, and one
    that fails between two places can run again. `buckets` must be the number it was stored with;
    one writer at a time. What comes to the driver is a list of bucket numbers.
    """
    fresh = entries.filter("key is not null")
    touched = sorted(r[0] for r in fresh.select(bucket_of(F.col("key"), buckets)).distinct().collect())
    if touched:
        stored = read_snapshot(spark, folder).filter(F.col("bucket").isin(touched)).drop("bucket")
        _write(stored.unionByName(fresh.select(*stored.columns)), folder, buckets, "overwrite")
    return touched
