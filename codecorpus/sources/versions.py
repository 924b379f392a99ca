"""Tables kept as versions: a new one is written whole beside the others, then named as the current one.

Below a root lie the versions, each a Parquet folder of its own that nothing changes later, and a
folder of small files that name them by number. A version counts once its name is there, and the
largest number is the current one. So a table is never half replaced, readers of an older version
keep it, and every older version is a backup.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from .listing import open_filesystem


def version_names(root: str) -> dict[int, str]:
    """The folder of each version by number; one entry per version ever published."""
    fs, base = open_filesystem(root)
    named = fs.get_file_info(pafs.FileSelector(f"{base.rstrip('/')}/published", allow_not_found=True))
    out = {}
    for info in named:
        if info.type == pafs.FileType.File and info.base_name.isdigit():
            with fs.open_input_stream(info.path) as stream:
                out[int(info.base_name)] = stream.read().decode()
    return out


def publish(df: DataFrame, root: str) -> int:
    """Writes the rows as the next version and makes it the current one; returns its number.

    Whatever fails before the name appears leaves the current version as it is; what was written
    until then stays unnamed. One writer at a time.
    """
    number = max(version_names(root), default=0) + 1
    folder = f"version-{number}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root.rstrip('/')}/{folder}")
    fs, base = open_filesystem(root)
    base = base.rstrip("/")
    fs.create_dir(f"{base}/published", recursive=True)
    draft = f"{base}/draft-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as stream:
        stream.write(folder.encode())
    fs.move(draft, f"{base}/published/{number:012d}")
    return number


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """A version by its number, the current one by default."""
    names = version_names(root)
    if not names or number is not None and number not in names:
        raise FileNotFoundError(f"{root} has no version {'' if number is None else number}".rstrip())
    return spark.read.parquet(f"{root.rstrip('/')}/{names[max(names) if number is None else number]}")


def revise(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Publishes a changed version of the current one, which stays as a backup; returns its number."""
    return publish(change(read_version(spark, root)), root)
