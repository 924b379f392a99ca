"""Packed token matrices: best-fit decreasing with a segment tree over room, written as binary rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.session import scratch_folder

from . import tokens
from .tables import pieces_for

#: Bytes of text whose pieces one task packs.
BUCKET_BYTES = 12 << 20


class RoomTree:
    """How many open sequences have each amount of room; finds the least room that suffices."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += by
            node >>= 1

    def at_least(self, room: int) -> int:
        """The smallest room >= `room` with an open sequence, or -1."""
        node = self.size + room
        if self.count[node]:
            return room
        while node > 1:  # up to the first right neighbour that holds any, then down its left side
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.size:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of piece numbers; lengths from 1 to capacity, ties in the given order."""
    tree, by_room, out = RoomTree(capacity), {}, []
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        room = tree.at_least(length)
        if room < 0:
            place, room = len(out), capacity
            out.append([])
        else:
            place = by_room[room].pop()
            tree.add(room, -1)
        out[place].append(k)
        if room > length:
            by_room.setdefault(room - length, []).append(place)
            tree.add(room - length, 1)
    return out


_SCHEMA = ("sequence_id long, n_tokens long, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
           "doc_ids array<{kind}>, pieces array<long>, starts array<long>")


def _packer(capacity: int, dtype: str, pad: int) -> Callable:
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bucket = table.column("bucket")[0].as_py()
        lengths = table.column("length").to_numpy()
        ids = table.column("ids").to_pylist()
        docs, piece, start = (table.column(c).combine_chunks() for c in ("doc_id", "piece", "start"))
        groups = best_fit_decreasing(lengths, capacity)
        order = pa.array([k for g in groups for k in g], pa.int64())
        cut = np.cumsum([0, *map(len, groups)]).astype(np.int32)
        rows, ends, resets = [], [], []
        for g in groups:
            row = np.full(capacity, pad, dtype)
            at = np.cumsum([0, *lengths[g].tolist()])
            row[:at[-1]] = np.frombuffer(b"".join(ids[k] for k in g), dtype)
            rows.append(row.tobytes())
            ends.append(at)
            resets.append(at[:-1])
        lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), x.take(order))
        return pa.table({
            "sequence_id": pa.array(bucket * 2**32 + np.arange(len(groups))),
            "n_tokens": pa.array([int(e[-1]) for e in ends], pa.int64()), "input_ids": pa.array(rows, pa.binary()),
            "cu_seqlens": pa.array(ends, pa.list_(pa.int32())), "position_resets": pa.array(resets, pa.list_(pa.int32())),
            "doc_ids": lists(docs), "pieces": lists(piece), "starts": lists(start)})
    return pack


def packed(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, dtype: str = "<u2", pad: int = 0
           ) -> DataFrame:
    """One row per sequence: input_ids (capacity ids of `dtype`, padded), cu_seqlens (0 and the end of
    each segment), position_resets (where positions start anew at 0), and the segments' doc_ids,
    pieces and starts in their documents.

    Documents are the tokenizer's ids and id 0. Longer ones are cut every `capacity` ids, and
    pieces in order give them back. Pieces are dealt to tasks by hash; each packs its own best-fit
    decreasing, so at most one sequence a task is fuller than need be. `dtype` must hold every id
    of the tokenizer. Null and empty texts are one id; null and repeated ids are carried; an
    empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0]
    buckets = pieces_for(size or 0, BUCKET_BYTES)
    cut = tokens.pieces(docs, capacity, tokenizer, with_ids=dtype)
    kind = cut.schema["doc_id"].dataType.simpleString()
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    return dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        _packer(capacity, dtype, pad), _SCHEMA.format(kind=kind))


def write_matrices(docs: DataFrame, folder: str, **options) -> None:
    """Writes `packed` rows as Parquet with binary matrix rows."""
    packed(docs, **options).write.option("compression", "zstd").parquet(folder)


def read_matrices(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def written(docs: DataFrame, **options) -> DataFrame:
    """Matrices written below the checkpoint folder and read back."""
    folder = scratch_folder(docs.sparkSession, "matrices")
    write_matrices(docs, folder, **options)
    return read_matrices(docs.sparkSession, folder)


def unpack_row(input_ids: bytes, cu_seqlens: list[int], dtype: str = "<u2") -> list[np.ndarray]:
    """The segments of a sequence."""
    row = np.frombuffer(input_ids, dtype)
    return [row[a:b] for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True)]
