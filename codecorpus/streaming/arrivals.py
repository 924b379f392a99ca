"""Process new script files as they appear."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..sources.files import chosen_files
from ..sources.listing import read_files


SEEN = "path string, rel string, n_bytes long, modified timestamp"
#: Files of a batch for each of its tasks, unless a caller says how many a batch may have.
TASK_FILES = 1000


def batch_files(spark: SparkSession) -> int:
    """Files of a batch by default: TASK_FILES for each task that reads them, so that a large tree takes few
    batches on a large cluster."""
    return TASK_FILES * int(spark.conf.get("spark.sql.shuffle.partitions"))


def discover(
    spark: SparkSession, root: str, log: str, max_files: int | None = None, recursive: bool = True,
    patterns: Sequence[str] | None = None, exclude: Sequence[str] = (),
) -> int:
    """Adds the chosen files below `root` that the log lacks to it; returns how many.

    The log is a Parquet table of paths and times of change: a file that changes is a new row. Rows
    that are in it count as found, however much of an append became visible before a failure,
    so what a failed one did not write is found again and nothing is found twice. One process at a
    time may write to a log. A file of the log holds `max_files` rows at most, `batch_files` by default.
    """
    max_files = max_files or batch_files(spark)
    spark.createDataFrame([], SEEN).write.mode("ignore").parquet(log)
    seen = spark.read.schema(SEEN).parquet(log).select("path", "modified")
    new = chosen_files(spark, root, recursive, patterns, exclude).join(seen, ["path", "modified"], "left_anti")
    n = new.count()
    if n:
        new.select("path", "rel", "n_bytes", "modified").repartition(-(-n // max_files)).write.mode("append").option(
            "maxRecordsPerFile", max_files).parquet(log)
    return n


def file_stream(spark: SparkSession, log: str) -> DataFrame:
    """Units of the files of a log, as they are added to it: one file of the log per batch.

    A file is read when its batch runs; a batch that runs again reads the same files.
    """
    return read_files(spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(log))


def watch_files(
    spark: SparkSession, root: str, output: str, checkpoint: str,
    change: Callable[[DataFrame], DataFrame], available_now: bool = True,
    max_files: int | None = None, recursive: bool = True, patterns: Sequence[str] | None = None,
    exclude: Sequence[str] = (), every: str = "10 seconds",
) -> StreamingQuery:
    """Apply `change` to every new file once, empty ones and names with an underscore included.

    Each micro-batch owns one ``progress=…/batch_id=…`` folder and overwrites it, so a batch that
    is repeated after a failure replaces its own half-written output. A stream with another
    checkpoint starts its batches anew, in a folder of its own. Below `checkpoint` lie the log of
    files and the progress of the stream over it. A batch has `max_files` files at most, by default as
    many as `batch_files` says. Without `available_now` the tree is listed
    at each tick, and what is new is processed before the next one.
    """
    own = f"{output.rstrip('/')}/progress={hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}"
    base = checkpoint.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{own}/batch_id={batch_id}")

    def process() -> StreamingQuery:
        discover(spark, root, f"{base}/files", max_files, recursive, patterns, exclude)
        return (file_stream(spark, f"{base}/files").writeStream.foreachBatch(write)
                .option("checkpointLocation", f"{base}/batches").trigger(availableNow=True).start())

    if available_now:
        return process()

    def tick(_batch: DataFrame, _batch_id: int) -> None:
        process().awaitTermination()

    ticks = spark.readStream.format("rate").load()
    return (ticks.writeStream.foreachBatch(tick).option("checkpointLocation", f"{base}/ticks")
            .trigger(processingTime=every).start())


#: Groups of keys that share a row of state; a call of Python for each would cost more than its keys.
KEY_GROUPS = 1024


def _decided(times: list[int], start: int, due: int, last: int | None, ttl: int, out: list[int]) -> int | None:
    """Appends the places from `start` to `due` of rows that pass to `out`; returns the time of the last that did."""
    at = start
    while at < due:
        if last is not None:  # straight to the first row that is due
            at = bisect_left(times, last + ttl, at, due)
            if at == due:
                break
        last = times[at]
        out.append(at)
        at += 1
    return last


def first_in_ttl(
    keyed: DataFrame, ttl_seconds: float, ts: str = "ts", lateness: str | None = None, groups: int = KEY_GROUPS,
) -> DataFrame:
    """(key, ts) of the first row of each key, and of each first row after its time to live, on a stream.

    What is kept of a key is the time it last passed. Once the watermark is past a key's time to live
    nothing is kept of it. Keys are dealt to `groups` rows of state by hash: the number must stay the
    same for a checkpoint, and a task holds one row of state at a time.

    Without `lateness` a row is decided in the batch that brings it. Rows of a batch are taken in
    order of time, so what passes does not depend on how rows fall into batches, as long as batches
    follow each other in time; a row older than a former batch's newest one is dropped.

    With `lateness`, an interval such as "10 minutes", a row waits until the watermark, the newest
    time less this interval, has reached it: rows up to so much late are taken in order with the
    others, whatever batches bring them, and what passes is what one batch over all of them gives.
    The state then holds the distinct times of a key that wait. The newest rows of a stream that ends
    wait for a newer one. Rows that are later still are dropped and counted: see `late_rows`.
    """
    ttl = int(ttl_seconds * 1_000_000)

    def passed(_group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, lasts, waiting = state.get if state.exists else ([], [], [])
        mark = state.getCurrentWatermarkMs()
        new = [] if state.hasTimedOut else [(f["key"].to_numpy(object), f["us"].to_numpy(np.int64)) for f in frames]
        held = np.repeat(np.arange(len(keys)), [len(w) for w in waiting])
        codes, names = pd.factorize(np.concatenate([np.array(keys, object), *(k for k, _ in new)]), use_na_sentinel=False)
        names = np.where(pd.isna(names), None, names)
        code = np.concatenate([held, codes[len(keys):]]).astype(np.int64)  # the keys held come first, in their order
        us = np.concatenate([np.array([t for w in waiting for t in w], np.int64), *(u for _, u in new)])
        order = np.lexsort((us, code))
        code, us = code[order], us[order]
        fresh = np.ones(len(us), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (us[1:] != us[:-1])
        code, us = code[fresh], us[fresh]
        bounds = np.searchsorted(code, np.arange(len(names) + 1))
        settled = np.ones(len(us), bool) if lateness is None else us <= mark * 1000
        dues = (bounds[:-1] + np.bincount(code[settled], minlength=len(names))).tolist()
        starts, times, out = bounds.tolist(), us.tolist(), []
        kept: tuple[list, list, list] = ([], [], [])
        wake = None
        for k, name in enumerate(names):
            last = _decided(times, starts[k], dues[k], lasts[k] if k < len(lasts) else None, ttl, out)
            rest = times[dues[k]:starts[k + 1]]
            if rest or last is not None and (last + ttl) // 1000 >= mark:
                for values, value in zip(kept, (name, last, rest), strict=True):
                    values.append(value)
                at = (rest[0] if rest else last + ttl) // 1000
                wake = at if wake is None else min(wake, at)
        if wake is None:
            state.remove()
        else:
            state.update(kept)
            state.setTimeoutTimestamp(max(wake, mark + 1))
        yield pd.DataFrame({"key": names[code[out]], "us": us[out]})

    # A row without a time counts as the oldest of its key.
    micros = F.coalesce(F.unix_micros(ts), F.lit(-(2**63)))
    timed = keyed.select("key", F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, lateness or "0 seconds")
    dealt = timed.withColumns({"us": micros, "group": F.pmod(F.xxhash64("key"), F.lit(groups))})
    rows = dealt.groupBy("group").applyInPandasWithState(
        passed, "key string, us long", "keys array<string>, last array<long>, waiting array<array<long>>",
        "append", "EventTimeTimeout")
    return rows.select("key", F.timestamp_micros("us").cast(keyed.schema[ts].dataType).alias(ts))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, in the batches whose progress the session keeps."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
