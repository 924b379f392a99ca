"""Exact top-k search by inner product with a table of distances to pivots.

For pivots p, |d(q, p) - d(c, p)| bounds the distance of q and c from below, so
(|q|^2 + |c|^2 - bound^2) / 2 bounds their inner product from above. Candidates are evaluated in
the order of their upper bounds until the next bound is below the k-th score found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import pieces_for, stored

PIVOTS, SAMPLE = 32, 2048
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1024
_STEP = 256


def finite(vector: F.Column) -> F.Column:
    """Whether a vector is there and all its components are finite numbers."""
    big = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < big), F.lit(False)))


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen so far."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax(np.einsum("ij,ij->i", sample, sample)))]
    gap = np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        d = sample - sample[chosen[-1]]
        gap = np.minimum(gap, np.einsum("ij,ij->i", d, d))
        nxt = int(np.argmax(gap))
        if gap[nxt] <= 0:
            break
        chosen.append(nxt)
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def exact_type(q: np.ndarray, c: np.ndarray) -> type:
    """The narrowest type in which inner products of these integer rows are exact."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[-1], 1)
    return np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else object


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of a row with rows, both in an exact type, held to the range of a long."""
    if q.dtype != object:
        return (c @ q).astype(np.int64)
    return np.array([min(max(int(v), -2**63), 2**63 - 1) for v in c @ q], np.int64)


def search_block(qid: np.ndarray, q: np.ndarray, dq: np.ndarray, cid: np.ndarray, c: np.ndarray, dc: np.ndarray,
                 k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query its k best candidates of a block: query ids, candidate ids, scores."""
    square_q, square_c = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
    kind = exact_type(q, c)
    whole_q, whole_c = (np.vectorize(int, otypes=[object])(x) if kind is object and x.size else x.astype(kind) for x in (q, c))
    near_c, near_q = dc.T.astype(np.float32), dq.astype(np.float32)
    for i in range(len(qid)):
        low = np.abs(near_c[0] - near_q[i, 0])
        for p in range(1, len(near_c)):
            np.maximum(low, np.abs(near_c[p] - near_q[i, p]), out=low)
        # distances are rounded: the bound gives way by far more than their error
        slack = 1e-5 * (square_q[i] + square_c + dq[i].max() ** 2 + 1)
        high = (square_q[i] + square_c - low.astype(float) ** 2) / 2 + slack
        high[cid == qid[i]] = -np.inf
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(-high)
        bounds, at, step = high[order], 0, _STEP
        stop = len(order) - int(np.count_nonzero(np.isneginf(bounds)))
        while at < stop and not (len(scores) >= k and bounds[at] < scores[-1]):
            if len(scores) >= k:  # later bounds that can't reach the k-th score are passed over at once
                stop = int(np.searchsorted(-bounds[:stop], -scores[-1], "right"))
            some = order[at:min(at + step, stop)]
            score = _products(whole_q[i], whole_c[some])
            good = score >= scores[-1] if len(scores) >= k else np.ones(len(score), bool)
            ids = np.concatenate([ids, cid[some[good]]])
            scores = np.concatenate([scores, score[good]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            at, step = at + step, step * 4
        yield np.full(len(ids), qid[i]), ids, scores


def _packer(pivots: dict[int, np.ndarray]) -> Callable:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["vector"].tolist(), float).reshape(len(rows), -1)
        width = x.shape[1]
        return pd.DataFrame({"width": [width], "block": rows["block"].iloc[:1].to_numpy(),
                             "ids": [rows["id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()],
                             "far": [distances(x, pivots.get(width, np.zeros((1, width)))).tobytes()]})
    return pack


def _searcher(k: int) -> Callable:
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                qid, cid = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.c_ids, np.int64)
                q, dq, c, dc = (np.frombuffer(raw, float).reshape(n, -1) for raw, n in (
                    (row.q_vectors, len(qid)), (row.q_far, len(qid)), (row.c_vectors, len(cid)), (row.c_far, len(cid))))
                found = [np.concatenate(x) for x in zip(*search_block(qid, q, dq, cid, c, dc, k), strict=True)]
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))
    return search


def top_k(vectors: DataFrame, queries: F.Column, k: int = 20, scale: float = 64.0,
          candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each query, ties to smaller ids.

    vectors: (vec_id, embedding). Components x become floor(scale * x); the score is the integer
    inner product, held to the range of a long. `queries` says which rows are queries. Every
    query meets every block of candidates; a task gets one block of each.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
    without an id. Rows that share an id count once, with the least of their vectors. Vectors are
    compared with those of as many components. An empty table gives no rows. Pivots come from at
    most `SAMPLE` rows, those with the least hashes of their ids, each for its own number of
    components; where none has that number, the origin is the pivot.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.withColumn("_asks", F.coalesce(queries, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("id"), "_asks", "embedding").filter(
        F.col("id").isNotNull() & finite(F.col("embedding")) & (F.size("embedding") > 0))
    rows = stored(rows.select("id", "_asks", whole.alias("vector")).groupBy("id").agg(
        F.min("vector").alias("vector"), F.max("_asks").alias("asks")), "vectors")
    total, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    by_width: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect():
        by_width.setdefault(len(r["vector"]), []).append(r["vector"])
    pivots = {w: choose_pivots(np.array(x, float)) for w, x in by_width.items()}

    def packed(part: DataFrame, blocks: int, name: str) -> DataFrame:
        cut = part.select("id", "vector", F.size("vector").alias("width"),
                          F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
        cut = cut.groupBy("width", "block").applyInPandas(
            _packer(pivots), "width int, block int, ids binary, vectors binary, far binary")
        return cut.select("width", *[F.col(c).alias(f"{name}_{c}") for c in cut.columns[1:]])

    many, few = pieces_for(total, candidate_block), pieces_for(asking, query_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))  # noqa: E731  a stated query set against all, in blocks
    left = packed(rows, many, "c").withColumn("q_block", every(few))
    right = packed(rows.filter("asks"), few, "q").withColumn("c_block", every(many))
    pairs = left.join(right, ["width", "q_block", "c_block"]).drop("width", "q_block", "c_block")
    best = pairs.mapInPandas(_searcher(k), "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
