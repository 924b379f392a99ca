"""Inference over a stream of requests, with a log that a later run takes up."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.inference import Client, run_inference
from ..schemas import RESPONSES


def settled(responses: DataFrame) -> DataFrame:
    """request_id of requests that need no further call: answered, or refused for good."""
    done = F.col("payload").isNotNull() | F.coalesce(F.col("error_class") == "non_retryable", F.lit(False))
    return responses.filter(done).select("request_id")


def answer_stream(
    requests: DataFrame, log: str, checkpoint: str, client_factory: Callable[[], Client],
    available_now: bool = True, **how: Any,
) -> StreamingQuery:
    """Calls for each request of a stream, batch by batch; answers are appended to a Parquet log.

    A batch leaves out the requests that the log has settled, so a run that was stopped is taken
    up again, by the same checkpoint or a new one, without a call whose answer was stored. What a
    stop can cost are the calls of the batch that was under way: bound it with the source's own
    limit (maxFilesPerTrigger). A request that repeats within a batch is called once. One stream
    at a time may append to a log; `how` goes to `run_inference`.
    """
    def call(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], RESPONSES).write.mode("ignore").parquet(log)
        stored = spark.read.schema(RESPONSES).parquet(log)
        todo = batch.dropDuplicates(["request_id"]).join(settled(stored), "request_id", "left_anti")
        run_inference(todo, client_factory, **how).write.mode("append").parquet(log)

    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return requests.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(**trigger).start()
