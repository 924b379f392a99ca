"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codecorpus.llm import quality
from codecorpus.llm.queries import ORACLES, QUERIES
from codecorpus.llm.tables import stored

from .test_documents import brute_repeats, shingle_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_stay_those_of_documents(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_rejected_documents_go(spark, steps):
    scores = quality.scored(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in scores.filter(F.col("score") >= 0.3).collect()}
    assert set(texts(steps[1])) == want and 0 < len(want) < steps[0].count()
    assert texts(steps[1]) == {d: t for d, t in texts(steps[0]).items() if d in want}


def test_one_of_each_group_stays(steps):
    rows = texts(steps[1])
    sets = {d: shingle_set(t) for d, t in rows.items()}
    root = {d: d for d in rows}
    for a in rows:
        for b in rows:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    low, high = sorted((root[a], root[b]))
                    root = {k: low if v == high else v for k, v in root.items()}
    assert texts(steps[2]) == {d: t for d, t in rows.items() if root[d] == d}


def test_one_row_of_each_group_stays(spark):
    def text(seed):
        return " ".join(f"w{seed}x{k}" for k in range(80))

    docs = [(5, text(0), "a"), (5, text(0), "a"), (5, text(0), "b"),  # rows alike, and alike but for the source
            (None, text(1), "a"), (None, text(1), "a"), (None, text(1) + " end", "b"),
            (1, text(2), "a"), (7, text(2) + " end", "a"), (7, text(3), "a"),  # one of two texts of an id is a copy
            (None, text(2), "a"), (8, text(4), "a"), (8, text(4) + " end", "a"),
            (9, None, "a"), (9, None, "a"), (None, "", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    near = corpus_pipeline.near_dedup(spark, df, SF)
    got = [(r["doc_id"], (r["text"] or "")[:4]) for r in near.collect()]
    assert near.dtypes == df.dtypes and sorted(got, key=str) == sorted(
        [(5, "w0x0"), (None, "w1x0"), (1, "w2x0"), (7, "w3x0"), (8, "w4x0"), (9, ""), (9, ""), (None, "")], key=str)
    kept = corpus_pipeline.repeat_dedup(spark, near, SF).collect()
    assert sorted((r["text"] or "")[:4] for r in kept) == ["", "", "", "w0x0", "w1x0", "w2x0", "w3x0", "w4x0"]


def test_repeats_are_cut(steps):
    rows = texts(steps[2])
    cut = brute_repeats(list(rows.values()), 200)
    assert texts(steps[3]) == {d: c[3].decode(errors="ignore") for d, c in zip(rows, cut, strict=True)}


def test_every_document_is_packed(steps):
    packed = steps[4].collect()
    assert {r["doc_id"] for r in packed} == set(texts(steps[3]))
    filled = {}
    for r in packed:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= 2048 and len(filled) <= sum(filled.values()) / 2048 * 1.05 + 1


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    from tests.oracle import compare, connect
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) is None
