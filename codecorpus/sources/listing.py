"""Listing a tree of files in tasks, and reading the files listed.

The tree is gone through in rounds. A round is a job over a table of folders: a task goes down from
each of its folders until it has seen a page of entries, and hands on the folders it has not opened.
They are dealt out anew for the next round, so deep, wide and lopsided trees spread alike, and no
list of files or folders passes through the driver. Names that start with a dot are hidden;
empty files and names that start with an underscore are files like any other.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder

FOUND = "rel string, folder boolean, n_bytes long, us long"
READ = "path string, code string, n_bytes long"
#: Entries a task sees below a folder before it hands on what it has not opened, and rows in a batch.
PAGE = 5000
#: Bytes of files a task reads into one batch.
READ_BYTES = 4 << 20
#: Schemes of object stores under the names that other readers use for them.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def split_uri(uri: str) -> tuple[str, str]:
    """(scheme, the rest); a path without a scheme is a local file."""
    m = re.match(r"([a-z][a-z0-9+.-]*):(?://)?(?=/|[^/])", uri)
    if not m or m[1] == "file":
        return "file", "/" + (uri[m.end():] if m else os.path.abspath(uri)).lstrip("/")
    return m[1], uri[m.end():]


def open_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI or a local path.

    Schemes with a file system of their own are opened with it; any other that a Hadoop
    installation knows (viewfs, a vendor's store) goes through its native library.
    """
    scheme, rest = split_uri(uri)
    if scheme == "file":
        return pafs.LocalFileSystem(), rest
    known = SCHEMES.get(scheme, scheme)
    if known in ("s3", "gs", "gcs", "abfs", "abfss", "hdfs"):
        return pafs.FileSystem.from_uri(f"{known}://{rest}")
    authority, _, inner = rest.partition("/")
    return pafs.HadoopFileSystem(host=f"{scheme}://{authority}" if authority else "default", port=0), "/" + inner


def plain_uri(uri: str) -> str:
    """The URI of a root, local ones with their scheme, without a slash at its end."""
    scheme, rest = split_uri(uri)
    return f"{scheme}://{rest}".rstrip("/")


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is a folder, bytes, time of change in microseconds) of a folder, one after the other.
    Links to folders are not followed; what is gone by the time it is looked at is left out."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                try:
                    is_folder = e.is_dir(follow_symlinks=False)
                    if is_folder or e.is_file():
                        stat = e.stat()
                        yield e.name, is_folder, stat.st_size, stat.st_mtime_ns // 1000
                except FileNotFoundError:
                    continue
    else:
        for i in fs.get_file_info(pafs.FileSelector(folder, recursive=False, allow_not_found=True)):
            yield i.base_name, i.type == pafs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1000


def _lister(root: str, recursive: bool, skip: frozenset[str], page: int):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_filesystem(root)
        base = base.rstrip("/") or "/"
        rows: list[tuple] = []

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["rel", "folder", "n_bytes", "us"])
            rows.clear()
            return out

        for batch in batches:
            for start in batch["rel"]:
                waiting, seen = [start], 0
                while waiting:
                    rel = waiting.pop()
                    if seen >= page:
                        rows.append((rel, True, 0, 0))
                        continue
                    for name, is_folder, size, us in _entries(fs, f"{base}/{rel}".rstrip("/") or "/"):
                        seen += 1
                        if name.startswith("."):
                            continue
                        inner = f"{rel}/{name}" if rel else name
                        if not is_folder:
                            rows.append((inner, False, size, us))
                        elif recursive and name not in skip:
                            waiting.append(inner)
                        if len(rows) >= page:
                            yield frame()
                if len(rows) >= page:
                    yield frame()
        if rows:
            yield frame()
    return step


def list_files(spark: SparkSession, root: str, recursive: bool = True, skip: Sequence[str] = (), page: int = PAGE) -> DataFrame:
    """(path, rel, n_bytes, modified) of the files below `root`, or of `root` itself if it is a file.

    Folders named in `skip` are not opened. The listing is stored below the shared checkpoint
    folder, so whatever is done with it later sees the same files. A folder's entries are streamed in
    pages on a local or mounted file system; other stores hand a task the entries of one folder.
    """
    uri, where = plain_uri(root), scratch_folder(spark, "listing")
    fs, base = open_filesystem(root)
    top = fs.get_file_info(base)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    if top.type == pafs.FileType.File:
        row = (uri, uri.rsplit("/", 1)[1], top.size, (top.mtime_ns or 0) // 1000)
        files = spark.createDataFrame([row], "path string, rel string, n_bytes long, us long")
        return files.select("path", "rel", "n_bytes", F.timestamp_micros("us").alias("modified"))
    step = _lister(root, recursive, frozenset(skip), page)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, number = spark.createDataFrame([("",)], "rel string"), 0
    while number == 0 or not folders.isEmpty():
        dealt = folders.repartition(tasks) if number else folders.coalesce(1)
        dealt.mapInPandas(step, FOUND).write.parquet(f"{where}/round={number}")
        folders = spark.read.schema(FOUND).parquet(f"{where}/round={number}").filter("folder").select("rel")
        number += 1
    found = spark.read.schema(FOUND + ", round int").option("basePath", where).parquet(where)
    return found.filter("not folder").select(
        F.concat(F.lit(uri + "/"), "rel").alias("path"), "rel", "n_bytes", F.timestamp_micros("us").alias("modified"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    systems: dict[str, pafs.FileSystem] = {}
    rows: list[tuple[str, str, int]] = []
    size = 0
    for batch in batches:
        for path in batch["path"]:
            scheme, rest = split_uri(path)
            root = scheme if scheme == "file" else f"{scheme}://{rest.split('/', 1)[0]}"
            if root not in systems:
                systems[root] = open_filesystem(path)[0]
            inner = rest if scheme == "file" else open_filesystem(path)[1]
            with systems[root].open_input_stream(inner) as stream:
                data = stream.read()
            rows.append((path, data.decode("utf8", errors="replace"), len(data)))
            size += len(data)
            if size >= READ_BYTES or len(rows) >= PAGE:
                yield pd.DataFrame(rows, columns=["path", "code", "n_bytes"])
                rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["path", "code", "n_bytes"])


def read_files(files: DataFrame) -> DataFrame:
    """The files that a table, or a stream, names in `path`, each whole as a unit with its size in bytes.

    Paths are dealt round robin, so a task that listed much does not read much. A null path is left
    out, a path that names no file stops the job; bytes that are no UTF-8 become replacement
    characters.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = files.select("path").filter("path is not null").repartition(tasks).mapInPandas(_read, READ)
    return read.select(F.col("path").alias("unit_id"), "path", F.lit("file").alias("kind"), "code", "n_bytes")
