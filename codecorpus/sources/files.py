"""Script files as units, path handling, and the plan preview."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import is_valid_source_path
from .listing import list_files, plain_uri, read_files

# What a directory scan takes and what it passes over, at any depth.
DEFAULT_PATTERNS = ("*.js", "*.mjs", "*.cjs")
EXCLUDED_FOLDERS = ("node_modules", ".git", "dist", "build")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as one unit, with its size in bytes."""
    return read_files(spark.createDataFrame([(plain_uri(path),)], "path string"))


def glob_regex(pattern: str) -> str:
    """A file glob (``*``, ``?``, ``**``, ``{a,b}``, ``[…]``) as an anchored pattern."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            body = pattern[i + 1:end]
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_any(rel_path: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | rel_path.rlike(glob_regex(p))
    return hit


def in_excluded_folder(rel_path: Column, folders: Sequence[str] = EXCLUDED_FOLDERS) -> Column:
    names = "|".join(re.escape(f) for f in folders)
    return rel_path.rlike(rf"(?:^|/)(?:{names})/")


def relative_path(path: Column, root: str) -> Column:
    """Path below `root`; both may carry a scheme."""
    base = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", root).rstrip("/")
    plain = F.regexp_replace(path, r"^[a-z][a-z0-9+.-]*:/*", "/")
    return F.when(
        plain.startswith(base + "/"), F.substring(plain, F.lit(len(base) + 2), F.length(plain))
    ).otherwise(plain)


def is_chosen(
    path: Column, rel_path: Column, recursive: bool = True,
    patterns: Sequence[str] | None = None, exclude: Sequence[str] = (),
) -> Column:
    """Whether a folder scan takes a file, from its path and its path below the root."""
    wanted = patterns or [("**/" if recursive else "") + p for p in DEFAULT_PATTERNS]
    keep = matches_any(rel_path, wanted) & ~in_excluded_folder(rel_path)
    skipped = [p.removeprefix("!") for p in exclude]
    if skipped:
        keep = keep & ~matches_any(rel_path, skipped)
    return keep & is_valid_source_path(path)


def select_paths(
    files: DataFrame, root: str = "", recursive: bool = True,
    patterns: Sequence[str] | None = None, exclude: Sequence[str] = (),
) -> DataFrame:
    """Filter a table with a path column the way a folder scan does."""
    rel = relative_path(F.col("path"), root) if root else F.col("path")
    return files.filter(is_chosen(F.col("path"), rel, recursive, patterns, exclude))


def chosen_files(
    spark: SparkSession, root: str, recursive: bool = True,
    patterns: Sequence[str] | None = None, exclude: Sequence[str] = (),
) -> DataFrame:
    """(path, rel, n_bytes, modified) of the files that a scan of `root` takes.

    The tree is listed once, in tasks; folders that are passed over are not opened.
    """
    listed = list_files(spark, root, recursive, skip=EXCLUDED_FOLDERS)
    return listed.filter(is_chosen(F.col("path"), F.col("rel"), recursive, patterns, exclude))


def scan_folder(
    spark: SparkSession, root: str, recursive: bool = True,
    patterns: Sequence[str] | None = None, exclude: Sequence[str] = (),
) -> DataFrame:
    """Script files below a folder as units; those passed over are filtered before any is opened."""
    return read_files(chosen_files(spark, root, recursive, patterns, exclude))


def distinct_paths(files: DataFrame) -> DataFrame:
    """One row per path."""
    return files.dropDuplicates(["path"])


def valid_paths(files: DataFrame) -> DataFrame:
    return files.filter(is_valid_source_path(F.col("path")))


def preview(files: DataFrame, first: int | None = None) -> DataFrame:
    """What a run would process: the number of files and their paths, or the first ones by path.

    Sort and limit together keep `first` rows per task. Nothing is written."""
    total = files.agg(F.count(F.lit(1)).alias("files"))
    top = files.select("path")
    if first is not None:
        top = top.orderBy("path").limit(first)
    return total.select(F.lit("files").alias("item"), F.col("files").cast("string").alias("value")) \
        .unionByName(top.select(F.lit("path").alias("item"), F.col("path").alias("value")))


def output_path(path: Column, output_dir: str | None = None, keep_tree: bool = True,
                root: str = "") -> Column:
    """Where the result of a file goes: the mirrored tree, one flat folder, or next to the
    input as ``name.readable.ext``."""
    if output_dir is not None:
        base = output_dir.rstrip("/")
        if keep_tree:
            rel = relative_path(path, root) if root else path
            return F.concat(F.lit(base + "/"), F.ltrim(rel, F.lit("/")))
        return F.concat(F.lit(base + "/"), F.element_at(F.split(path, "/"), -1))
    ext = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    stem = F.left(path, F.length(path) - F.length(ext))
    return F.concat(stem, F.lit(".readable"), ext)
