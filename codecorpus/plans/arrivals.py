"""Files written and scanned, files that arrive, and repeated keys on a stream.

These queries write below the shared checkpoint folder; what they return derives from the
given tables only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_folder
from ..sources import files as fl
from ..sources import sinks, versions
from ..sources.listing import plain_uri, read_files
from ..streaming import arrivals as ar
from . import relations as rel
from .registry import register, with_ctes

NAME_SQL = r"""names AS (
  SELECT unit_id, code, CASE page_id % 4 WHEN 0 THEN '_' || page_id WHEN 1 THEN 'f' || page_id
           WHEN 2 THEN '__tests__/f' || page_id ELSE 'node_modules/f' || page_id END
         || CASE WHEN starts_with(unit_id, 'snippet/') THEN 's' ELSE '' END
         || CASE page_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.mjs' ELSE '.txt' END AS name
  FROM scripts)"""


def _named(spark, sf_dir):
    p = F.col("page_id")
    stem = rel.pick([F.lit("_"), F.lit("f"), F.lit("__tests__/f"), F.lit("node_modules/f")], p)
    ext = rel.pick([F.lit(".js"), F.lit(".mjs"), F.lit(".txt")], p)
    return rel.scripts(spark, sf_dir).select(
        F.concat(stem, p.cast("string"), F.when(F.col("unit_id").startswith("snippet/"), "s").otherwise(""), ext)
        .alias("name"), "code")


def _write(spark, sf_dir, folder):
    root = F.lit(folder.rstrip("/") + "/")
    rows = _named(spark, sf_dir).select(F.concat(root, "name").alias("path"), "code")
    sinks.write_files(rows).write.format("noop").mode("overwrite").save()


def _back(units, folder):
    rel_path = fl.relative_path(F.col("path"), folder)
    return units.select(rel_path.alias("name"), F.sha2("code", 256).alias("digest"), "n_bytes")


@register("scanned_files", with_ctes(rel.SCRIPTS_SQL, NAME_SQL, body="""
SELECT name, sha256(code) AS digest, octet_length(encode(code)) AS n_bytes FROM names
WHERE NOT contains(name, 'node_modules/') AND NOT ends_with(name, '.txt')"""))
def scanned_files(spark, sf_dir):
    """Every script as a file, and the folder scanned; empty and underscored names too."""
    folder = scratch_folder(spark, "scripts")
    _write(spark, sf_dir, folder)
    return _back(fl.scan_folder(spark, folder), folder)


@register("files_read_whole", with_ctes(rel.SCRIPTS_SQL, NAME_SQL, body="""
SELECT name, sha256(code) AS digest, octet_length(encode(code)) AS n_bytes FROM names"""))
def files_read_whole(spark, sf_dir):
    """Every script as a file, and each file that a table names read whole, with its size."""
    folder = scratch_folder(spark, "wholes")
    _write(spark, sf_dir, folder)
    paths = _named(spark, sf_dir).select(F.concat(F.lit(plain_uri(folder) + "/"), "name").alias("path"))
    return _back(read_files(paths), folder)


@register("arriving_files", with_ctes(rel.SCRIPTS_SQL, NAME_SQL, body="""
SELECT name, sha256(code) AS digest, octet_length(encode(code)) AS n_bytes FROM names
WHERE NOT contains(name, 'node_modules/') AND NOT ends_with(name, '.txt')"""))
def arriving_files(spark, sf_dir):
    """Every script as a file that arrives; the stream runs twice and repeats nothing. Empty files and
    underscored names arrive too."""
    folder = scratch_folder(spark, "arrivals")
    out, checkpoint = scratch_folder(spark, "processed"), scratch_folder(spark, "progress")
    _write(spark, sf_dir, folder)
    for _ in range(2):
        ar.watch_files(
            spark, folder, out, checkpoint, lambda df: _back(df, folder)).awaitTermination()
    return spark.read.schema("name string, digest string, n_bytes long").parquet(
        f"{out}/progress=*/batch_id=*")


TTL_DAYS = 10


@register("first_keys_on_stream", f"""
WITH RECURSIVE e AS (SELECT user_id || '-' || event_type AS key, ts FROM events),
due AS (
  SELECT key, min(ts) AS ts FROM e GROUP BY key
  UNION ALL
  SELECT d.key, min(e.ts) AS ts FROM due d JOIN e ON e.key = d.key AND e.ts >= d.ts + INTERVAL {TTL_DAYS} DAY
  GROUP BY d.key, d.ts)
SELECT key, epoch_us(ts) AS at_us FROM due""")
def first_keys_on_stream(spark, sf_dir):
    """Keys of the event stream, once each within ten days of event time."""
    out, checkpoint = scratch_folder(spark, "keys"), scratch_folder(spark, "progress")
    schema = rel.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option(
        "pathGlobFilter", "events.parquet").parquet(sf_dir)
    keyed = stream.select(F.concat_ws("-", "user_id", "event_type").alias("key"), "ts")
    firsts = ar.first_in_ttl(keyed, ttl_seconds=TTL_DAYS * 86_400)
    (firsts.writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
     .awaitTermination())
    return spark.read.schema(firsts.schema).parquet(out).select(
        "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


BLOCK_DAYS = 4
#: Rows of a file of a block, about: files are written, and read, by a task each.
BLOCK_FILE_ROWS = 200_000


@register("late_keys_on_stream", f"""
WITH RECURSIVE e AS (SELECT user_id || '-' || event_type AS key, ts FROM events),
due AS (
  SELECT key, min(ts) AS ts FROM e GROUP BY key
  UNION ALL
  SELECT d.key, min(e.ts) AS ts FROM due d JOIN e ON e.key = d.key AND e.ts >= d.ts + INTERVAL {TTL_DAYS} DAY
  GROUP BY d.key, d.ts)
SELECT key, epoch_us(ts) AS at_us FROM due""")
def late_keys_on_stream(spark, sf_dir):
    """The same keys from batches out of order: blocks of four days of which each second comes before
    the first, and at last a row that lets those that wait go."""
    source, out, checkpoint = (scratch_folder(spark, n) for n in ("blocks", "keys", "progress"))
    events = rel.table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", "event_type").alias("key"), "ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, newest, rows = events.agg(F.min(us), F.max(us), F.count(us)).first()
    length = BLOCK_DAYS * 86_400_000_000
    block = F.floor((us - (first or 0)) / length).cast("long")
    blocks = ((newest or 0) - (first or 0)) // length + 2
    files = -(-rows // (blocks * BLOCK_FILE_ROWS)) or 1  # of each block, and of each batch
    for k in range(blocks):
        events.filter(block.bitwiseXOR(F.lit(1)) == k).repartition(files).write.mode("append").parquet(source)
    last = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit("").alias("key"), "ts")
    last.write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(source)
    firsts = ar.first_in_ttl(stream, ttl_seconds=TTL_DAYS * 86_400, lateness=f"{2 * BLOCK_DAYS} days")
    (firsts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(firsts.schema).parquet(out).select(
        "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


@register("refused_overwrites", with_ctes(rel.UNITS_SQL, rel.REWORKED_SQL, body="""
SELECT unit_id, s.code = r.code AS written, CASE WHEN s.code <> r.code THEN 'FILE_WRITE_ERROR' END AS error_code
FROM scripts s JOIN reworked r USING (unit_id)"""))
def refused_overwrites(spark, sf_dir):
    """Scripts written as files, then their second version onto the same files."""
    folder = scratch_folder(spark, "outputs")
    scripts = rel.scripts(spark, sf_dir).withColumn(
        "path", F.concat(F.lit(folder + "/"), "unit_id"))
    sinks.write_files(scripts).write.format("noop").mode("overwrite").save()
    again = sinks.write_files(rel.reworked(scripts))
    return again.select(
        fl.relative_path(F.col("path"), folder).alias("unit_id"), "written", "error_code")


@register("rewritten_with_backup", with_ctes(rel.SCRIPTS_SQL, body=r"""
SELECT unit_id, 'old' AS version, sha256(code) AS digest FROM scripts
UNION ALL SELECT unit_id, 'new', sha256(replace(code, ';', ';' || chr(10))) FROM scripts"""))
def rewritten_with_backup(spark, sf_dir):
    """A table of scripts changed in place, and the copy kept of it."""
    path, backups = scratch_folder(spark, "table"), scratch_folder(spark, "backups")
    sinks.write_table(rel.scripts(spark, sf_dir).select("unit_id", "code"), path)
    backup = sinks.rewrite_with_backup(
        spark, path, backups, "first",
        lambda df: df.withColumn("code", F.replace("code", F.lit(";"), F.lit(";\n"))))

    def digests(folder, version):
        return spark.read.schema("unit_id string, code string").parquet(folder).select(
            "unit_id", F.lit(version).alias("version"), F.sha2("code", 256).alias("digest"))

    return digests(backup, "old").unionByName(digests(path, "new"))


@register("revised_versions", with_ctes(rel.SCRIPTS_SQL, body=r"""
SELECT unit_id, 1::BIGINT AS version, sha256(code) AS digest FROM scripts
UNION ALL SELECT unit_id, 2, sha256(replace(code, ';', ';' || chr(10))) FROM scripts"""))
def revised_versions(spark, sf_dir):
    """A table of scripts published, a changed version of it, and both read back."""
    root = scratch_folder(spark, "versions")
    versions.publish(rel.scripts(spark, sf_dir).select("unit_id", "code"), root)
    versions.revise(spark, root, lambda df: df.withColumn("code", F.replace("code", F.lit(";"), F.lit(";\n"))))
    old, new = (versions.read_version(spark, root, n).select(
        "unit_id", F.lit(n).cast("long").alias("version"), F.sha2("code", 256).alias("digest")) for n in (1, 2))
    return old.unionByName(new)
