"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

A table rotates vectors by rounds of random signs and a fast Hadamard transform; a hash is the
axis with the largest absolute coordinate and its sign, and a bucket joins a few such hashes. A
vector stands in its own bucket and in the buckets its next best axes lead to. Two vectors
meet where one of them is at home, and all pairs that meet are verified by their cosine.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, find
from .pivots import finite
from .tables import pieces_for, stored
from .textbytes import U64, mix

ROUNDS, PROBES = 3, 1
#: Vectors of one bucket that a task compares at once; larger buckets are compared block by block.
BLOCK = 1024
#: The share of pairs at the least cosine that all tables together may miss.
MISS = 1e-4
#: Components that the simulation of a table draws, and the chances of meeting that it may tell.
DRAWN, CHANCES = 1 << 20, (1e-3, 0.99)


def padded_width(width: int) -> int:
    return 1 << max(width - 1, 1).bit_length()


@functools.lru_cache(maxsize=256)
def meeting_chance(axes: int, width: int, least: float) -> float:
    """The chance that two vectors at a cosine of `least` meet in one table, by a seeded simulation.

    Two standard errors are taken off, so that chance makes for more tables and not for fewer.
    """
    rng, tables = np.random.default_rng(11), 4
    n = min(2000, max(16, DRAWN // width))
    a, b = rng.normal(size=(2, n, width))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = least * a + math.sqrt(max(0.0, 1 - least * least)) * b / np.linalg.norm(b, axis=1)[:, None]
    ka, kb = bucket_keys(a, axes, tables), bucket_keys(b, axes, tables)
    p = float(((ka[:, :, :1] == kb) | (kb[:, :, :1] == ka)).any(axis=2).mean())
    low, high = CHANCES
    return min(high, max(low, p - 2 * math.sqrt(p * (1 - p) / (n * tables))))


def shape_for(n: int, width: int, least: float = 0.9) -> tuple[int, int]:
    """Axes per bucket and tables: about n / 4 buckets or more, and at most MISS of the pairs missed."""
    axes = 1
    while (2 * width) ** axes < n / 4:
        axes += 1
    return axes, math.ceil(math.log(MISS) / math.log1p(-meeting_chance(axes, padded_width(width), least)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, by sums and differences alone."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width)


def bucket_keys(x: np.ndarray, axes: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """Keys (rows x tables x 1 + probes), a vector's own bucket first; tables and widths have other keys."""
    n, width = x.shape
    padded = np.zeros((n, padded_width(width)))
    padded[:, :width] = x
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng(1000 + t)
        ranked, loss = [], []
        for _ in range(axes):
            y = padded
            for _ in range(ROUNDS):
                y = hadamard(y * rng.choice([-1.0, 1.0], y.shape[1]))
            y /= np.sqrt(y.shape[1]) ** ROUNDS
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes + 1]
            high = np.take_along_axis(y, top, 1)
            ranked.append(2 * top + (high < 0))
            loss.append(np.abs(high[:, :1]) - np.abs(high))
        # probes change one axis to one of its next best, those that lose least first
        option = np.stack([lost[:, 1:] for lost in loss], axis=1).reshape(n, -1)
        best = np.argsort(option, axis=1, kind="stable")[:, :probes]
        for p in range(probes + 1):
            key = np.full(n, U64((width << 24) + t + 1))
            for a in range(axes):
                axis = ranked[a][:, 0]
                if p and best.shape[1] >= p:
                    pick = best[:, p - 1]
                    use = pick // (ranked[a].shape[1] - 1) == a
                    axis = np.where(use, ranked[a][np.arange(n), 1 + pick % (ranked[a].shape[1] - 1)], axis)
                key = mix(key * U64(0x9E3779B97F4A7C15) + axis.astype(np.uint64))
            out[:, t, p] = key
    return out


def _unit(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float).reshape(len(vectors), -1)


def _of_width(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows parted by the number of components, in the order they have."""
    width = rows["vector"].map(len).to_numpy()
    for w in np.unique(width).tolist():
        yield rows[width == w]


def _hasher(shapes: dict[int, tuple[int, int]]) -> Callable:
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 4096):
                for part in _of_width(f.iloc[i:i + 4096]):
                    x = _unit(part["vector"])
                    keys = bucket_keys(x, *shapes[padded_width(x.shape[1])]).view(np.int64)
                    n, each = len(part), keys.shape[1] * keys.shape[2]
                    home = np.tile(np.arange(keys.shape[2]) == 0, n * keys.shape[1])
                    once = home | (keys != keys[:, :, :1]).ravel()  # where axes are few, a probe can lead back home
                    yield pd.DataFrame({"key": keys.ravel(), "class_id": np.repeat(part["class_id"].to_numpy(), each),
                                        "home": home})[once]
    return place


def _near_pairs(x: np.ndarray, home: np.ndarray, side: np.ndarray, across: bool, least: float
                ) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket (or of two of its blocks) that may be near and of which one is at home."""
    near = np.triu(x @ x.T >= least - 1e-9, 1)
    near &= home[:, None] | home[None, :]
    if across:
        near &= side[:, None] != side[None, :]
    return np.nonzero(near)


def _counted(pairs: list[tuple], ids: np.ndarray, many: np.ndarray, x: np.ndarray, least: float, axes: int, tables: int
             ) -> pd.DataFrame:
    """Links per vector, and edges that span them, of pairs of rows (a, b, bucket key).

    A pair that meets in several buckets is counted in the first table, and there in the lesser key.
    """
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    own = np.concatenate([np.full(len(p[0]), p[2], np.int64) for p in pairs]).view(np.uint64)
    square = np.einsum("ij,ij->i", x, x)
    fit = (x[a] * x[b]).sum(axis=1) / (np.sqrt(square[a]) * np.sqrt(square[b])) >= least
    a, b, own = a[fit], b[fit], own[fit]
    if not len(a):
        return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "Int64", "b": "Int64", "n": "int64"})
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys = bucket_keys(x[rows], axes, tables)
    pa, pb = place[:len(a)], place[len(a):]
    keep = np.zeros(len(a), bool)
    for i in range(0, len(a), 1 << 15):
        cut = slice(i, i + (1 << 15))
        ka, kb = keys[pa[cut]], keys[pb[cut]]
        b_comes, a_comes = (kb == ka[:, :, :1]).any(axis=2), (ka == kb[:, :, :1]).any(axis=2)
        first = np.argmax(a_comes | b_comes, axis=1)
        at = np.arange(len(first))
        here = ((ka[at, first, 0] == own[cut]) & b_comes[at, first]) | ((kb[at, first, 0] == own[cut]) & a_comes[at, first])
        both = a_comes[at, first] & b_comes[at, first]
        keep[cut] = here & (~both | (np.minimum(ka[at, first, 0], kb[at, first, 0]) == own[cut]))
    a, b = a[keep], b[keep]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, many[b])
    np.add.at(links, b, many[a])
    nodes, where = np.unique(ids[np.concatenate([a, b])], return_inverse=True)
    parent, edges = np.arange(len(nodes)), []
    for u, v in zip(where[:len(a)].tolist(), where[len(a):].tolist(), strict=True):
        u, v = find(parent, u), find(parent, v)
        if u != v:
            parent[max(u, v)] = min(u, v)
            edges.append((u, v))
    some = np.flatnonzero(links)
    ends = nodes[np.array(edges, np.int64).reshape(-1, 2)]
    return pd.concat([
        pd.DataFrame({"a": pd.array(ids[some], "Int64"), "b": pd.array([pd.NA] * len(some), "Int64"), "n": links[some]}),
        pd.DataFrame({"a": pd.array(ends[:, 0], "Int64"), "b": pd.array(ends[:, 1], "Int64"), "n": np.zeros(len(ends), np.int64)}),
    ])


#: Pairs held before they are counted.
MOST_PAIRS = 1 << 19


def _verifier(least: float, shapes: dict[int, tuple[int, int]]) -> Callable:
    """Streams rows sorted by bucket and block pair; each is compared in one go."""
    group = ["key", "low", "high"]

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            x, marks = _unit(f["vector"]), f[group].to_numpy()
            unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            axes, tables = shapes[padded_width(x.shape[1])]
            ids, many, home, side = (f[c].to_numpy() for c in ("class_id", "many", "home", "block"))
            ends = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(f)]
            pairs, held = [], 0
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                if e - s > 1 and home[s:e].any():
                    a, b = _near_pairs(unit[s:e], home[s:e], side[s:e], marks[s, 1] != marks[s, 2], least)
                    if len(a):
                        pairs.append((a + s, b + s, marks[s, 0]))
                        held += len(a)
                if held >= MOST_PAIRS:
                    yield _counted(pairs, ids, many, x, least, axes, tables)
                    pairs, held = [], 0
            if pairs:
                yield _counted(pairs, ids, many, x, least, axes, tables)

        rest: list[pd.DataFrame] = []
        for f in frames:
            if f.empty:
                continue
            rows = pd.concat([*rest, f], ignore_index=True)
            open_ = (rows[group] == rows[group].iloc[-1]).all(axis=1)
            rest = [rows[open_]]
            for part in _of_width(rows[~open_]):  # a bucket holds vectors of one width
                yield from told(part)
        if rest:
            yield from told(rest[0])
    return verify


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Rows are linked if their cosine, in double precision, is `least` or more; n_links counts the
    other rows linked directly. Equal vectors form one class that is hashed once. Pairs that meet in
    no bucket are missed: about MISS of those at the threshold, fewer above it.

    Vectors that are null, empty, zero or hold null or non-finite components are linked with
    nothing, and so are rows without an id. Vectors of different lengths are never linked. Rows
    that share an id are one row, with the least of their usable vectors. An empty table gives no
    rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(
        finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull(),
        F.col("embedding")).alias("vector"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    usable = rows.filter("vector is not null")
    length = F.greatest(F.size("vector") - 1, F.lit(1))
    counted = usable.groupBy(F.length(F.bin(length.cast("long"))).alias("bits")).count().collect()  # 31 rows at most
    shapes = {1 << r["bits"]: shape_for(r["count"], 1 << r["bits"], least) for r in counted}
    classes = stored(usable.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("many")), "classes")
    spots = classes.select("class_id", "vector").mapInPandas(
        _hasher(shapes), "key long, class_id long, home boolean")
    spots = stored(spots, "buckets")
    sizes = spots.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("used")).filter("n > 1 and used")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (spots.join(sizes, "key").withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("class_id", "key", "home", "block", F.least("block", "other").alias("low"),
                      F.greatest("block", "other").alias("high")))
    met = (placed.join(classes, "class_id")
           .repartition(max(8, pieces_for(sum(r["count"] * shapes[1 << r["bits"]][1] for r in counted), 50_000)), "key", "low", "high")
           .sortWithinPartitions("key", "low", "high")
           .select("key", "low", "high", "block", "home", "class_id", "many", "vector")
           .mapInPandas(_verifier(least, shapes), "a long, b long, n long"))
    met = stored(met, "links")
    links = met.groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(met.filter("b is not null"), "a", "b")
    told = (classes.join(links, F.col("a") == F.col("class_id"), "left").join(roots, F.col("id") == F.col("class_id"), "left")
            .select("class_id", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                    F.coalesce("root", "class_id").alias("component_id")))
    members = usable.join(classes.select("vector", "class_id"), "vector").select("vec_id", "class_id")
    found = members.join(told, "class_id").select("vec_id", "n_links", "component_id")
    return (rows.select("vec_id").join(found, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
