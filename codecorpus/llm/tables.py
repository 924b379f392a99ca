"""Reading the given tables and keeping results between jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codecorpus.session import scratch_folder


#: Rows in an Arrow batch of whole texts; Spark's own default of 10000 is meant for narrow rows.
BATCH_ROWS = 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its texts reach Python in batches of BATCH_ROWS, unless the session says less."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet below spark.checkpoint.dir and read again: lineage ends here."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces_for(total: float, each: float) -> int:
    """How many pieces of about `each` units hold `total` units; one at least."""
    return max(1, -(-int(total or 0) // int(each)))
