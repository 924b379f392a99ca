"""The response cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fingerprint as fp
from ..operators import cache as op
from ..operators import snapshots
from ..session import ensure_checkpoint_dir, scratch_folder
from . import relations as rel
from .registry import register, with_ctes

SETTINGS = {"provider": {"name": "openai", "model": "gpt-4o", "apiKey": "secret"},
            "chunkSize": 4000, "steps": ["unpack", "rename", "format"]}
CANONICAL = ('{"chunkSize":4000,"provider":{"model":"gpt-4o","name":"openai"},'
             '"steps":["unpack","rename","format"]}')


@register("unit_keys", with_ctes(rel.UNITS_SQL, body=f"""
SELECT unit_id, left(sha256(sha256(code) || '|' || '{CANONICAL}'), 32) AS key FROM units"""))
def unit_keys(spark, sf_dir):
    settings = F.lit(fp.canonical_settings(SETTINGS))
    return rel.units(spark, sf_dir).select(
        "unit_id", fp.unit_key(F.col("code"), settings).alias("key"))


@register("chain_keys", with_ctes(rel.SETTINGS_SQL, body="""
SELECT setting_id, left(sha256('unpack,rename,format|'
    || '{"max_tokens":' || max_tokens || ',"model":"' || model || '","provider":"' || provider || '"}'), 16) AS key
FROM settings"""))
def chain_keys(spark, sf_dir):
    steps = F.array(*[F.lit(s) for s in SETTINGS["steps"]])
    chosen = F.to_json(F.struct("max_tokens", "model", "provider"))
    return rel.settings(spark, sf_dir).select(
        "setting_id", fp.chain_key(steps, chosen).alias("key"))


def _cache(spark, sf_dir):
    entries = rel.cache_entries(spark, sf_dir)
    return op.upsert(entries.limit(0), entries)


CACHE_COLS = """key, length(payload) AS payload_length, epoch_us(created_at) AS created_us,
       epoch_us(expires_at) AS expires_us, size"""


def _cache_cols(df):
    return df.select(
        "key", F.length("payload").cast("long").alias("payload_length"),
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("expires_at").alias("expires_us"), "size")


@register("cache_upserted", with_ctes(rel.ENTRIES_SQL, body=f"SELECT {CACHE_COLS} FROM cache"))
def cache_upserted(spark, sf_dir):
    """An older generation of all entries, then the current one on top."""
    entries = rel.cache_entries(spark, sf_dir)
    day = F.expr("INTERVAL 24 HOURS")
    older = entries.withColumns({c: F.col(c) - day for c in ("created_at", "expires_at")})
    return _cache_cols(op.upsert(op.upsert(entries.limit(0), older), entries))


@register("cache_snapshot_upserted", with_ctes(rel.ENTRIES_SQL, body=f"SELECT {CACHE_COLS} FROM cache"))
def cache_snapshot_upserted(spark, sf_dir):
    """An older generation of all entries as a stored cache, then the current one upserted in three parts."""
    entries, folder = rel.cache_entries(spark, sf_dir), scratch_folder(spark, "cache")
    day = F.expr("INTERVAL 24 HOURS")
    snapshots.write_snapshot(
        entries.withColumns({c: F.col(c) - day for c in ("created_at", "expires_at")}), folder, buckets=16)
    for part in range(3):
        snapshots.upsert_snapshot(
            spark, folder, entries.filter(F.pmod(F.hash("payload"), F.lit(3)) == part), buckets=16)
    return _cache_cols(snapshots.read_snapshot(spark, folder))


@register("cache_after_expiry", with_ctes(rel.ENTRIES_SQL, body=f"""
SELECT {CACHE_COLS} FROM cache WHERE expires_at >= TIMESTAMP '{rel.NOW}'"""))
def cache_after_expiry(spark, sf_dir):
    return _cache_cols(op.drop_expired(_cache(spark, sf_dir), rel.now()))


@register("cache_hits", with_ctes(rel.ENTRIES_SQL, rel.LOOKUPS_SQL, body=f"""
SELECT request_id, l.key, length(payload) AS payload_length
FROM lookups l JOIN cache c ON c.key = l.key AND expires_at >= TIMESTAMP '{rel.NOW}'"""))
def cache_hits(spark, sf_dir):
    hits = op.cache_hits(rel.lookups(spark, sf_dir), _cache(spark, sf_dir), rel.now())
    return hits.select(
        "request_id", "key", F.length("cached_payload").cast("long").alias("payload_length"))


@register("cache_misses", with_ctes(rel.ENTRIES_SQL, rel.LOOKUPS_SQL, body=f"""
SELECT request_id, key FROM lookups l
WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.key = l.key AND expires_at >= TIMESTAMP '{rel.NOW}')"""))
def cache_misses(spark, sf_dir):
    return op.cache_misses(
        rel.lookups(spark, sf_dir), _cache(spark, sf_dir), rel.now()).select("request_id", "key")


@register("calls_to_make", with_ctes(rel.ENTRIES_SQL, rel.LOOKUPS_SQL, body=f"""
SELECT min(request_id) AS request_id, key FROM lookups l
WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.key = l.key AND expires_at >= TIMESTAMP '{rel.NOW}') GROUP BY key"""))
def calls_to_make(spark, sf_dir):
    return op.calls_to_make(rel.lookups(spark, sf_dir), _cache(spark, sf_dir), rel.now())


def _evicted_sql(space: int) -> str:
    return with_ctes(rel.ENTRIES_SQL, body=f"""
SELECT {CACHE_COLS} FROM (
  SELECT *, sum(size) OVER (ORDER BY created_at, key ROWS UNBOUNDED PRECEDING) - size AS before FROM cache)
WHERE before >= {space}""")


@register("cache_after_eviction", _evicted_sql(1_000_000))
def cache_after_eviction(spark, sf_dir):
    """The cache is pinned first: eviction reads its narrow columns several times."""
    ensure_checkpoint_dir(spark)
    return _cache_cols(op.evict_oldest(_cache(spark, sf_dir).checkpoint(), 1_000_000))


@register("cache_stats", with_ctes(rel.ENTRIES_SQL, rel.LOOKUPS_SQL, body=f"""
SELECT (SELECT count(*) FROM cache) AS entries, (SELECT sum(size) FROM cache)::BIGINT AS size_bytes,
       hits, misses, hits::DOUBLE / (hits + misses) AS hit_rate
FROM (SELECT count(c.key) AS hits, count(*) - count(c.key) AS misses
      FROM lookups l LEFT JOIN cache c ON c.key = l.key AND expires_at >= TIMESTAMP '{rel.NOW}')"""))
def cache_stats(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    return op.cache_stats(op.lookup(rel.lookups(spark, sf_dir), cache, rel.now()), cache)


@register("entry_sizes", with_ctes(rel.LOOKUPS_SQL, body="""
SELECT 'd' || doc_id AS request_id, length(to_json(text)) * 2 AS size FROM documents"""))
def entry_sizes(spark, sf_dir):
    made = op.make_entries(
        rel.table(spark, sf_dir, "documents").select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"),
            F.col("text").alias("payload")), rel.now())
    return made.select(F.col("key").alias("request_id"), "size")
