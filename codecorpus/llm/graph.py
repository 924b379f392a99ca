"""Connected components by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

MAX_ROUNDS = 64


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within each batch: every node linked to the smallest it reaches there."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = np.arange(len(nodes))
        for x, y in zip(inverse[:len(a)].tolist(), inverse[len(a):].tolist(), strict=True):
            x, y = find(parent, x), find(parent, y)
            parent[max(x, y)] = min(x, y)
        root = np.array([find(parent, i) for i in range(len(nodes))], np.int64)
        moved = root != np.arange(len(nodes))
        yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root) of every id in an edge: root is the smallest id that links lead to.

    Edges are contracted by union-find within batches, then by large-star and small-star
    rounds until nothing changes. A node's links are only joined to one minimum, so a
    node with very many of them is split by Spark's skew join. Null ends are left out.
    """
    links = (edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
             .filter("a is not null and b is not null and a <> b")
             .mapInArrow(_forest, "a long, b long").distinct())
    links, before = stored(links, "links"), None
    for _ in range(MAX_ROUNDS):
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            return links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
                links.select("b", "b").distinct())
        before = tuple(mark)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        links = stored(small.select("e.*").filter("a <> b").distinct(), "links")
    raise RuntimeError("components did not settle")
