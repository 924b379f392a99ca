"""The operators on vectors against brute force and on odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecorpus.llm import crosspoly, pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(seed=1, n=300, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, width))
    x = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.2, 0.4, 1.0], (n, 1))
    x[50:60] = x[49]
    return x.astype(np.float32)


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in zip(ids or range(len(x)), x, strict=True)], SCHEMA)


def brute_top(x, k, scale=64.0):
    whole = np.floor(x.astype(float) * scale).astype(np.int64)
    out = set()
    for q in range(0, len(x), 20):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:k]
        out |= {(q, r, int(i), int(score[i])) for r, i in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("blocks", [(2048, 2048), (40, 7)])
def test_top_k_equals_brute_force(spark, blocks):
    x = clustered()
    got = pivots.top_k(table(spark, x), F.col("vec_id") % 20 == 0, candidate_block=blocks[0], query_block=blocks[1])
    assert {tuple(r) for r in got.collect()} == brute_top(x, 20)


def test_vectors_of_several_widths_are_each_compared(spark, monkeypatch):
    monkeypatch.setattr(pivots, "SAMPLE", 40)
    parts, rows = [clustered(seed=w, width=w)[:n] for w, n in ((24, 100), (16, 60), (3, 40), (17, 2))], []
    for k, x in enumerate(parts):
        rows += [(1000 * k + i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in pivots.top_k(docs, F.col("vec_id") % 20 == 0, candidate_block=30, query_block=3).collect()}
    assert got == {(1000 * k + q, r, 1000 * k + i, s) for k, x in enumerate(parts) for q, r, i, s in brute_top(x, 20)}
    got = {tuple(r) for r in crosspoly.near_vectors(docs).collect()}
    assert got == {(1000 * k + i, n, 1000 * k + c, own) for k, x in enumerate(parts) for i, n, c, own in brute_links(x, 0.9)}


@pytest.mark.parametrize("width", [16, 64, 200, 1024])
@pytest.mark.parametrize("least", [0.7, 0.8, 0.95])
def test_pairs_meet_at_other_widths_and_thresholds(width, least):
    rng = np.random.default_rng(5)
    axes, tables = crosspoly.shape_for(2000, width, least)
    a, b = rng.normal(size=(2, 300, width))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = least * a + math.sqrt(1 - least * least) * b / np.linalg.norm(b, axis=1)[:, None]
    ka, kb = (crosspoly.bucket_keys(v, axes, tables) for v in (a, b))
    assert ((ka[:, :, :1] == kb) | (kb[:, :, :1] == ka)).any(axis=(1, 2)).mean() >= 0.99


def test_search_stops_early_and_is_exact():
    x = np.floor(clustered(n=2000) * 64).astype(float)
    far = pivots.distances(x, pivots.choose_pivots(x))
    ids = np.arange(len(x))
    (q, found, score), = pivots.search_block(ids[:1], x[:1], far[:1], ids, x, far, 5)
    want = sorted(((-int(x[0] @ x[i]), i) for i in range(1, len(x))))[:5]
    assert [(-int(s), int(i)) for s, i in zip(score, found, strict=True)] == want and set(q) == {0}


def test_top_k_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (1, [nan, 1.0], 0), (2, [inf, 1.0], 0), (3, None, 0), (4, [], 0), (5, [1.0, None], 0),
            (6, [3.0, 1.0], 0), (6, [3.0, 1.0], 0), (None, [1.0, 1.0], 0), (20, [1.0, 2.0], 0), (7, [1.0, 2.0, 3.0], 0)]
    got = pivots.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, 1, 6, 20480), (0, 2, 20, 20480), (20, 1, 0, 20480), (20, 2, 6, 20480)]
    assert pivots.top_k(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert pivots.top_k(spark.createDataFrame([(1, [1.0], 0)], SCHEMA), F.lit(True)).count() == 0


def test_products_beyond_doubles(spark):
    x = [[2.0**34, 3.0], [2.0**14 + 1, 1.0], [-(2.0**61), 0.0]]
    got = pivots.top_k(spark.createDataFrame([(i, r, 0) for i, r in enumerate(x)], SCHEMA), F.col("vec_id") == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [
        (0, 1, 1, 2**40 * (2**20 + 64) + 192 * 64), (0, 2, 2, -2**63)]


def brute_links(x, least):
    x = x.astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    root = list(range(len(x)))
    for a, b in zip(*np.nonzero(near), strict=True):
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return {(i, int(near[i].sum()), root[i], root[i] == i) for i in range(len(x))}


@pytest.mark.parametrize("block", [1024, 6])
def test_near_vectors_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(crosspoly, "BLOCK", block)
    x = clustered()
    got = {tuple(r) for r in crosspoly.near_vectors(table(spark, x)).collect()}
    assert got == brute_links(x, 0.9) and sum(r[1] for r in got) > 300


def test_near_vectors_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [nan, 1.0], 0),
            (6, [1.0, None], 0), (7, [1.0, 0.0, 0.0], 0), (8, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    got = {tuple(r) for r in crosspoly.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 2, 1, True), (2, 2, 1, False), (8, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True),
                   (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 0, None, True)}
    assert crosspoly.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(1).normal(size=(4, 16))
    assert np.allclose(crosspoly.hadamard(crosspoly.hadamard(x)) / 16, x)


@pytest.mark.parametrize("n", [500, 50_000, 3_000_000])
def test_pairs_at_the_threshold_meet(n):
    rng = np.random.default_rng(7)
    axes, tables = crosspoly.shape_for(n, 64)
    a = rng.normal(size=(1500, 64))
    b = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    ka, kb = (crosspoly.bucket_keys(v, axes, tables) for v in (a, b))
    met = ((ka[:, :, :1] == kb) | (kb[:, :, :1] == ka)).any(axis=(1, 2))
    assert met.mean() > 0.999
