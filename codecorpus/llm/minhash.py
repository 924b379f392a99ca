"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

A document's set holds the distinct 64-bit hashes of its word shingles. SuperMinHash gives each
element one random permutation of the signature's slots: its j-th slot receives j + r with r in
[0, 1), a slot keeps the least value, and elements stop once j passes the largest value kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, find
from .tables import pieces_for, stored
from .textbytes import U64, blocks, mix, shingles, texts_of, words

SLOTS, ROWS = 128, 4
#: Hashes of sets that one task compares at once; larger families are compared block by block.
BLOCK_HASHES = 1 << 17


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def super_minhash(elements: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots) of the sets elements[bounds[i]:bounds[i + 1]]; infinite if empty."""
    rows = len(bounds) - 1
    sig = np.full(rows * slots, np.inf)
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    seeds = mix(np.arange(1, 2 * slots + 1, dtype=np.uint64) * U64(0xD1342543DE82EF95))
    perm = None
    for j in range(slots):
        if not len(elements):
            break
        r = _unit(mix(elements + seeds[2 * j]))
        u = _unit(mix(elements + seeds[2 * j + 1]))
        k = j + np.minimum((u * (slots - j)).astype(np.int64), slots - j - 1)
        at = np.arange(len(elements))
        slot = k if perm is None else perm[at, k]
        np.minimum.at(sig, owner * slots + slot, r + j)
        # early stop: a later step adds at least j + 1, which no full slot below that can take
        on = (sig.reshape(rows, slots).max(axis=1) > j + 1)[owner]
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (int(on.sum()), 1))
            elements, owner, k = elements[on], owner[on], k[on]
            at = np.arange(len(elements))
            perm[at, k] = perm[at, j]
        else:
            perm[at, k] = perm[at, j]
            elements, owner, perm = elements[on], owner[on], perm[on]
    return sig.reshape(rows, slots)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per band of `rows` slots, other bands having other keys."""
    n, bands = len(sig), sig.shape[1] // rows
    bits = np.ascontiguousarray(sig[:, :bands * rows]).view(np.uint64).reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for r in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key


def _sets(view, offsets, i: int, j: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of rows i to j, and their bounds."""
    hashes, at = words(view, offsets, i, j)
    found = [np.unique(shingles(hashes[at[k]:at[k + 1]], width)) for k in range(j - i)]
    return (np.concatenate(found) if found else hashes), np.cumsum([0, *map(len, found)])


def _class_of(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set: equal sets, and only they, share it."""
    sums = np.concatenate([[U64(0)], np.cumsum(mix(elements + U64(77)), dtype=np.uint64)])
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) * U64(3) + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _sketcher(width: int, slots: int, rows: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view, offsets = texts_of(batch.column(1))
            for i, j in blocks(offsets):
                elements, bounds = _sets(view, offsets, i, j, width)
                sizes = np.diff(bounds)
                keys = band_keys(super_minhash(elements, bounds, slots), rows).view(np.int64)
                flat = pa.array(keys[sizes > 0].ravel())
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, keys.shape[1], 0))])
                yield pa.record_batch([
                    batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(sizes.astype(np.int64)),
                    pa.array(_class_of(elements, bounds)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat),
                    *(c.slice(i, j - i) for c in batch.columns[2:]),
                ], ["doc_id", "n_shingles", "class_id", "bands", *batch.schema.names[2:]])
    return sketch


def _setter(width: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view, offsets = texts_of(batch.column(0))
            for i, j in blocks(offsets):
                elements, bounds = _sets(view, offsets, i, j, width)
                raw = elements.tobytes()
                yield pa.record_batch([
                    pa.array(_class_of(elements, bounds)), batch.column(1).slice(i, j - i),
                    pa.array([raw[8 * bounds[k]:8 * bounds[k + 1]] for k in range(j - i)], pa.binary()),
                ], ["class_id", "wanted", "members"])
    return sets


def _links(classes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, across: bool, percent: int
           ) -> list[tuple[int, int]]:
    """Links that join the sets of a family: counts of common hashes come from an inverted index.

    Sets are taken by size; a set meets the earlier ones that are large enough, and only
    those union-find has not yet put beside it. With `across`, only sets of other sides.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, classes, side = sizes[order], classes[order], side[order]
    sets = [sets[k] for k in order]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    by_id = np.argsort(ids, kind="stable")
    posts, first = owner[by_id], np.searchsorted(ids[by_id], np.arange(len(ids) + 1))
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))  # where a set's hash stands among its postings
    at = np.concatenate([[0], np.cumsum(sizes)])
    parent, out = np.arange(len(sets)), []
    for k in range(1, len(sets)):
        own = slice(at[k], at[k + 1])
        lows, highs = first[ids[own]], rank[own]  # postings before its own: smaller sets
        spans = highs - lows
        if not spans.any():
            continue
        where = np.repeat(lows - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        common = np.bincount(posts[where], minlength=k)
        met = np.flatnonzero(100 * common >= percent * (sizes[:k] + sizes[k] - common))
        for other in met.tolist():
            if across and side[other] == side[k]:
                continue
            x, y = find(parent, k), find(parent, other)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(classes[k]), int(classes[other])))
    return out


def _verifier(percent: int) -> Callable:
    """Streams rows sorted by family; each family's sets are compared in one go."""
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def compare(rows: pd.DataFrame) -> list[tuple[int, int]]:
            out = []
            for _, g in rows.groupby(["family", "low", "high"], sort=False):
                if len(g) > 1:
                    out += _links(g["class_id"].to_numpy(), [np.frombuffer(m, np.uint64) for m in g["members"]],
                                  g["block"].to_numpy(), bool(g["low"].iloc[0] != g["high"].iloc[0]), percent)
            return out

        def told(rows: list[tuple[int, int]]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

        for frame in frames:
            if frame.empty:
                continue
            rows = pd.concat([*held, frame], ignore_index=True)
            last = rows[["family", "low", "high"]].iloc[-1]
            open_ = (rows[["family", "low", "high"]] == last).all(axis=1)
            held = [rows[open_]]
            yield told(compare(rows[~open_]))
        if held:
            yield told(compare(held[0]))
    return verify


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, slots: int = SLOTS,
                    rows: int = ROWS) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, component_id and kept.

    Rows are linked if 100 * intersection >= percent * union of their shingle sets. Equal sets
    form one class at once. Classes that share a band of the signature are candidates: with the
    defaults a pair at 0.85 is missed with a probability of 6e-11, at 0.8 of 5e-8. Classes that
    candidates connect form a family; the links within it are confirmed on full sets, large
    families block by block. component_id is the smallest doc_id that links lead to.

    Null texts are empty; empty rows are linked with nothing. Rows that repeat are duplicates of
    each other. Rows with a null doc_id are linked with nothing: their component_id is null and
    they are kept. Rows that share a doc_id but not a text may each be linked. Other columns of
    docs are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _linked(docs, percent, width, slots, rows)


def _linked(docs: DataFrame, percent: int, width: int = 5, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """near_duplicates of (doc_id long, text string); columns after these two are carried along."""
    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[2:]]
    docs, carrying = docs.select("doc_id", "text"), docs
    sketches = stored(carrying.mapInArrow(_sketcher(width, slots, rows), ", ".join(
        ["doc_id long, n_shingles long, class_id long, bands array<long>", *others])), "sketches")
    filled = sketches.filter("n_shingles > 0 and doc_id is not null")
    keys = filled.select("class_id", "bands").dropDuplicates(["class_id"]).select(
        "class_id", F.explode("bands").alias("key"))
    low = keys.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).filter("low < high")
    family = components(keys.join(low, "key").select("class_id", "low").distinct(), "class_id", "low")

    # one text for each class of a family; its set, hashed anew, must be the class it stands for
    texts = filled.groupBy("class_id").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"))
    members = stored(family.withColumnRenamed("id", "class_id").join(texts, "class_id"), "members")
    sets = (docs.join(members.select("doc_id", F.col("class_id").alias("wanted")).hint("merge"), "doc_id")
            .select("text", "wanted").mapInArrow(_setter(width), "class_id long, wanted long, members binary")
            .filter("class_id = wanted").drop("wanted").dropDuplicates(["class_id"]))
    weights = members.groupBy("root").agg(F.sum("n_shingles").alias("weight"))
    count = F.ceil(F.col("weight") / BLOCK_HASHES).cast("int")
    placed = (members.select("class_id", "root").join(weights, "root")
              .withColumn("blocks", count)
              .withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("class_id", F.col("root").alias("family"), "block",
                      F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    parts = pieces_for(members.agg(F.sum("n_shingles")).first()[0], BLOCK_HASHES)
    links = (sets.join(placed, "class_id")
             .repartition(max(parts, 8), "family", "low", "high").sortWithinPartitions("family", "low", "high")
             .select("family", "low", "high", "block", "class_id", "members")
             .mapInPandas(_verifier(percent), "a long, b long"))
    # dealt out anew: verifying and union-find in one task would need two Python workers, which stay and hold memory
    linked = components(links.distinct(), "a", "b")

    joined = linked.withColumnRenamed("id", "class_id").join(texts, "class_id")
    least = joined.groupBy("root").agg(F.min("doc_id").alias("least"))
    ids = joined.join(least, "root").select("class_id", "least").union(
        texts.join(linked, texts.class_id == linked.id, "left_anti").select("class_id", "doc_id"))
    full = sketches.join(ids, "class_id", "left").withColumn(
        "component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least"))
        .otherwise(F.col("doc_id")))
    return full.select("doc_id", "n_shingles", "component_id",
                       F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *carrying.columns[2:])


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates: of its rows of the smallest doc_id, the one of the least hash.

    Rows are linked one by one, whatever ids they share: of texts that share a doc_id, only those go
    that are near copies of a row that stays. Rows with a null doc_id are linked like others and come
    after every id; of rows alike in all columns one stays. Rows without words are linked with
    nothing and all stay. Rows are told apart by 64-bit hashes of all their columns beside the
    doc_id; columns called _none, _own or _row are not allowed.
    """
    key, own = ["_none", "_own", "_row"], F.col("doc_id").cast("long")
    rows = docs.withColumns({"_none": own.isNull(), "_own": F.coalesce(own, F.lit(0)), "_row": F.xxhash64(*docs.columns)})
    found = _linked(rows.select(F.col("_row").alias("doc_id"), F.col("text").cast("string").alias("text"), "_none", "_own"), percent)
    told = stored(found.filter("n_shingles > 0").groupBy(
        "component_id", "_none", "_own", F.col("doc_id").alias("_row")).agg(F.count("*").alias("many")), "told")
    first = told.groupBy("component_id").agg(F.min(F.struct(*key, "many")).alias("first")).select("first.*")
    gone = told.select(key).join(first.filter("many = 1"), key, "left_anti")
    left = rows.join(gone, key, "left_anti")
    again = first.filter("many > 1").select(key)
    if not again.isEmpty():  # all copies of these are gone; one comes back
        left = left.unionByName(rows.join(again, key, "left_semi").dropDuplicates(key))
    return left.select(docs.columns)
