"""Nothing is cut: limits, sizes and error rows that earlier versions let fall."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions import chunks as ch
from codecorpus.functions.text import exact_mean, exact_sum
from codecorpus.operators import chunking, classify, identifiers, normalize, renames, report


def test_sums_of_tiny_and_huge_values(spark):
    rows = [("tiny", 1e-13)] * 5 + [("huge", 1e21)] * 3 + [("both", 1e21), ("both", 0.25)] + [("plain", 0.07), ("plain", 0.14)]
    rows += [("far", 1e-200), ("none", None)]
    got = {r[0]: (r[1], r[2]) for r in spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(
        exact_sum(F.col("v")), exact_mean(F.col("v"))).collect()}
    assert abs(got["tiny"][0] - 5e-13) < 1e-26 and abs(got["huge"][0] - 3e21) < 1e8
    assert got["both"][0] == 1e21 + 0.25 and got["plain"][0] == 0.21 and got["far"][0] == 1e-200
    assert got["none"] == (None, None)


def test_trend_of_tiny_and_huge_samples(spark):
    rows = [(k, i, i, v * (1 if i < 2 else 2), 0.5, 0.5) for k, v in (("tiny", 1e-13), ("huge", 1e21)) for i in range(5)]
    df = spark.createDataFrame(rows, "run_id string, ts long, sample_id long, throughput double, cpu double, memory double")
    got = {(r.run_id, r.sample_id): r.trend for r in report.throughput_trend(df, 3).collect()}
    assert abs(got["tiny", 4] - 1) < 1e-9 and abs(got["huge", 4] - 1) < 1e-9 and got["tiny", 3] is None


def test_long_units_are_cleaned(units):
    text = "a  ;;  b\n" * 25_000
    row = normalize.preprocess(units(text)).first()
    assert row.profile == "chunks" and len(row.code) < len(text) * 0.8 and "  " not in row.code


def test_large_units_stay(units):
    kept, errors = classify.split_oversize(units("x" * 50, "y"), 10)
    assert {(r.code, r.oversize) for r in kept.collect()} == {("x" * 50, True), ("y", False)} and errors.count() == 1
    assert classify.split_oversize(units("x" * 50))[1].count() == 0


def test_unusable_answers_leave_error_rows(spark):
    rows = [("bad", '[{"name":"c"}]'), ("empty", "no rename here"), ("text", "a -> b"), ("ok", '[{"name":"a","newName":"b"},7]')]
    got = renames.parse_with_fallback(spark.createDataFrame(rows, "request_id string, payload string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.request_id, []).append((r.ordinal, r.original_name, r.error is None))
    assert by == {"bad": [(0, None, False)], "empty": [(None, None, False)], "text": [(0, "a", True)],
                  "ok": [(0, "a", True), (1, None, False)]}


def test_an_answer_is_parsed_once(spark):
    df = spark.createDataFrame([("a", "[]")], "request_id string, payload string")
    plan = renames.parse_with_fallback(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") <= 20


def test_parallel_and_plain_items(spark):
    payload = '[{"name":["a","b"],"newName":["x","y","z"]},{"name":"c","newName":"w"},"odd",{"name":"d"}]'
    got = renames.pair_parallel_arrays(spark.createDataFrame([("r", payload)], "request_id string, payload string")).collect()
    assert [(r.ordinal, r.name, r.new_name) for r in got] == [(0, "a", "x"), (1, "b", "y"), (2, "c", "w")]


def test_empty_units_are_put_together_again(units):
    for cut in (chunking.fixed_chunks, chunking.boundary_chunks, chunking.token_chunks, chunking.overlap_chunks):
        assert [(r.code, r.n_chunks) for r in chunking.reassemble(cut(units(""))).collect()] == [("", 1)]


def test_many_chunks_equal_few_blocks(spark):
    text = "abc;" * 3000
    df = spark.createDataFrame([(text,)], "code string").select(ch.boundary_chunks(F.col("code"), 10).alias("c"))
    parts = df.first().c
    assert len(parts) > 5 * ch.BLOCK and "".join(p.text for p in parts) == text


def test_terms_beyond_a_few(units):
    names = [f"t{i}" for i in range(60)]
    got = {r.term: r.n for r in identifiers.count_terms(units(" ".join(names) + " t3 t3"), [*names, "absent"]).collect()}
    assert got == {n: 3 if n == "t3" else 1 for n in names} | {"absent": 0}
