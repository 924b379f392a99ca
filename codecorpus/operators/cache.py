"""A response cache kept as a table (key, payload, created_at, expires_at, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.fingerprint import entry_size, json_string
from ..session import ensure_checkpoint_dir
from .skew import join_unique

# Fixed value: entries live one hour unless told otherwise.
DEFAULT_TTL = 3_600


def make_entries(results: DataFrame, created_at: Column, ttl: int = DEFAULT_TTL) -> DataFrame:
    """Cache entries of (key, payload)."""
    return results.select(
        "key", "payload", created_at.alias("created_at"),
        (created_at + F.make_interval(secs=F.lit(ttl))).alias("expires_at"),
        entry_size(json_string(F.col("payload"))).alias("size"),
    )


def drop_expired(cache: DataFrame, now: Column) -> DataFrame:
    """Entries still valid at `now`; one that expires exactly then is."""
    return cache.filter(F.col("expires_at") >= now)


def lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (with key) and the payload of their valid entry, plus a hit flag.

    The presence of the row decides, not its value.
    """
    valid = drop_expired(cache, now).select(
        F.col("key"), F.col("payload").alias("cached_payload"), F.lit(True).alias("hit")
    )
    return join_unique(requests, valid, "key").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_hits(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    valid = drop_expired(cache, now).select("key", F.col("payload").alias("cached_payload"))
    return join_unique(requests, valid, "key", "inner")


def cache_misses(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests without a valid entry."""
    return join_unique(requests, drop_expired(cache, now).select("key"), "key", "left_anti")


def calls_to_make(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """One request (the first by id) per key without a valid entry: what inference is for.

    Requests that share a key share its answer. They are reduced to one row per key and task
    before the shuffle, so nothing is skewed afterwards.
    """
    rest = [c for c in requests.columns if c not in ("key", "request_id")]
    first = requests.groupBy("key").agg(F.min(F.struct("request_id", *rest)).alias("r"))
    missing = first.join(drop_expired(cache, now).select("key"), "key", "left_anti")
    return missing.select("key", "r.*").select(*requests.columns)


def upsert(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Latest entry per key. A maximum, combined before the shuffle: a key that holds a
    large part of all entries sends one row per task."""
    cols = [c for c in cache.columns if c != "key"]
    order = F.struct("created_at", *[c for c in cols if c != "created_at"])
    both = cache.unionByName(entries.select(*cache.columns))
    latest = both.groupBy("key").agg(F.max(order).alias("e"))
    return latest.select(*[F.col("key") if c == "key" else F.col(f"e.{c}").alias(c)
                           for c in cache.columns])


def evict_oldest(cache: DataFrame, space: int) -> DataFrame:
    """What remains after removing the oldest entries until `space` bytes are free.

    The order is (created_at, key). Narrow rows are range-partitioned by it and pinned; the
    ranges' totals, one number each, tell which range holds the cut, and a running total runs
    through that range only. The entries are then filtered in place by the cut, without a
    shuffle. The cut is found when this is called.
    """
    if space <= 0:
        return cache
    ensure_checkpoint_dir(cache.sparkSession)
    micros = F.unix_micros("created_at")
    ranged = (
        cache.select(micros.alias("t"), "key", "size").repartitionByRange("t", "key")
        .withColumn("range", F.spark_partition_id()).checkpoint()
    )
    before = 0
    for number, total in sorted(ranged.groupBy("range").agg(F.sum("size")).collect()):
        if before + total >= space:
            break
        before += total
    else:
        return cache.filter(F.lit(False))
    w = W.partitionBy("range").orderBy("t", "key").rowsBetween(W.unboundedPreceding, 0)
    upto = ranged.filter(F.col("range") == number).withColumn("upto", F.sum("size").over(w))
    cut = upto.filter(F.col("upto") >= space - before).agg(F.min(F.struct("t", "key"))).first()[0]
    return cache.filter((micros > cut["t"]) | ((micros == cut["t"]) & (F.col("key") > cut["key"])))


def cache_stats(looked_up: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: entries, bytes, hits, misses, hit rate (0 without lookups)."""
    held = cache.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size_bytes"),
        F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("misses"),
    )
    asked = looked_up.agg(
        F.lit(0).cast("long").alias("entries"), F.lit(0).cast("long").alias("size_bytes"),
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
    )
    total = held.unionByName(asked).agg(
        *[F.sum(c).cast("long").alias(c) for c in ("entries", "size_bytes", "hits", "misses")]
    )
    n = F.col("hits") + F.col("misses")
    return total.withColumn(
        "hit_rate", F.coalesce(F.try_divide(F.col("hits").cast("double"), n), F.lit(0.0))
    )
