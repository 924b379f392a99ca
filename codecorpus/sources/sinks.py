"""Writing results: refuse to overwrite, or back up first."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from .listing import open_filesystem


def write_table(df: DataFrame, path: str, force: bool = False, by: tuple[str, ...] = ()) -> None:
    """Write as Parquet. Existing output is an error unless `force` is set."""
    writer = df.write.mode("overwrite" if force else "errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def rewrite_with_backup(
    spark: SparkSession, path: str, backup_root: str, run_id: str,
    change: Callable[[DataFrame], DataFrame],
) -> str:
    """Replace a table by a changed version of itself and keep the old one.

    The old version is copied to ``run_id=…`` below `backup_root` first, and the new one is
    computed from that copy, so that overwriting never reads what it replaces. A run id can
    be used once. Returns the backup path. A failure while the table is overwritten leaves only
    the backup whole; `versions.revise` switches a table whole.
    """
    backup = f"{backup_root.rstrip('/')}/run_id={run_id}"
    spark.read.parquet(path).write.mode("errorifexists").parquet(backup)
    change(spark.read.parquet(backup)).write.mode("overwrite").parquet(path)
    return backup


FILE_RESULT = "path string, written boolean, error_code string, error_message string"


def _write_files(force: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: set[str] = set()
        for batch in batches:
            rows = []
            for path, code in batch.itertuples(index=False):
                if not isinstance(path, str) or not path or not isinstance(code, str):
                    rows.append((path, False, "INVALID_INPUT", "A file needs a path and a text"))
                    continue
                fs, inner = open_filesystem(path)
                data = code.encode("utf8", "replace")
                found = fs.get_file_info(inner)
                taken = found.type != pafs.FileType.NotFound
                if taken and not force and not _holds(fs, inner, found.size, data):
                    rows.append((path, False, "FILE_WRITE_ERROR",
                                 f"Output file already exists: {path}"))
                    continue
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    made.add(folder)
                draft = f"{inner}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(draft) as stream:
                    stream.write(data)
                fs.move(draft, inner)
                rows.append((path, True, None, None))
            yield pd.DataFrame(rows, columns=["path", "written", "error_code", "error_message"])

    return write


def _holds(fs: pafs.FileSystem, path: str, size: int | None, data: bytes) -> bool:
    if size != len(data):
        return False
    with fs.open_input_stream(path) as stream:
        return stream.read() == data


def write_files(units: DataFrame, force: bool = False) -> DataFrame:
    """Write each unit (path, code) to a file of its own and report one row per file.

    A file that exists with other content is an error row unless `force` is set. One with
    the same content counts as written, because a task that runs again after the loss of an
    executor meets the files of its first attempt. A null path or text, and an empty path, is an
    error row. A file appears under its name only when it is complete. The result is lazy: nothing is written until it is read or stored.
    """
    return units.select("path", "code").mapInPandas(_write_files(force), FILE_RESULT)
