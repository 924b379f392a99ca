"""Cache, reports and counts against plain loops, with skewed inputs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from codecorpus.functions import fingerprint as fp
from codecorpus.operators import cache as ca
from codecorpus.operators import features as ft
from codecorpus.operators import identifiers as ids
from codecorpus.operators import report as rp
from codecorpus.operators import skew, snapshots

CACHE = "key string, payload string, created_at timestamp, expires_at timestamp, size long"


def at(seconds: float):
    return F.timestamp_micros(F.lit(int(seconds * 1_000_000)))


def entries(spark, rows):
    """(key, created second, size, time to live)"""
    df = spark.createDataFrame(rows, "key string, t double, size long, ttl long")
    created = F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))
    return df.select("key", F.concat(F.lit("p"), "key").alias("payload"), created.alias("created_at"),
                     (created + F.make_interval(secs=F.col("ttl"))).alias("expires_at"), "size")


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("space", [0, 1, 500, 2500, 10**9])
def test_eviction_equals_a_loop(spark, space, hot):
    rng = random.Random(space + hot)
    rows = []
    for _ in range(200):
        t = 5000.25 if hot and rng.random() < 0.7 else rng.choice([1.0, 2.5, 7200.0, rng.random() * 1e6])
        key = ("aaaa" if hot and rng.random() < 0.5 else "") + f"{rng.getrandbits(64):016x}"
        rows.append((key, t, rng.randint(1, 30), 10))
    cache = entries(spark, rows)
    want, freed = set(), 0
    for key, _t, size, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if freed >= space:
            want.add(key)
        freed += size
    assert {r.key for r in ca.evict_oldest(cache, space).collect()} == want


def test_expiry_is_strict(spark):
    cache = entries(spark, [("a", 0.0, 1, 10), ("b", 0.0, 1, 11), ("c", 0.0, 1, 9)])
    assert {r.key for r in ca.drop_expired(cache, at(10)).collect()} == {"a", "b"}


def test_upsert_keeps_the_latest_entry_of_a_hot_key(spark):
    rows = [("hot", float(i), 1, 10) for i in range(500)] + [("cold", 1.0, 2, 10)]
    out = ca.upsert(entries(spark, rows[:100]), entries(spark, rows[100:]))
    got = {r.key: r.created_at.timestamp() for r in out.withColumn(
        "created_at", F.col("created_at")).collect()}
    assert len(got) == 2 and out.filter("key = 'hot'").select(F.unix_micros("created_at")).first()[0] == 499_000_000


def test_lookup_counts_null_payloads_as_hits(spark):
    cache = entries(spark, [("a", 0.0, 1, 10)]).withColumn("payload", F.lit(None).cast("string"))
    asked = spark.createDataFrame([("r1", "a"), ("r2", "b")], "request_id string, key string")
    seen = ca.lookup(asked, cache, at(1))
    row = ca.cache_stats(seen, cache).first()
    assert (row.entries, row.size_bytes, row.hits, row.misses, row.hit_rate) == (1, 1, 1, 1, 0.5)
    none = ca.cache_stats(seen.limit(0), cache.limit(0)).first()
    assert tuple(none) == (0, 0, 0, 0, 0.0)


def test_keys_depend_on_every_setting_but_not_on_secrets_or_order(spark):
    a = {"provider": {"name": "x", "model": "m", "apiKey": "1"}, "steps": ["a", "b"]}
    b = {"steps": ["a", "b"], "provider": {"apiKey": "2", "model": "m", "name": "x"}}
    c = {"provider": {"name": "x", "model": "other", "apiKey": "1"}, "steps": ["a", "b"]}
    assert fp.canonical_settings(a) == fp.canonical_settings(b) != fp.canonical_settings(c)
    df = spark.createDataFrame([("code",)], "code string").select(
        fp.unit_key(F.col("code"), F.lit(fp.canonical_settings(a))).alias("k"),
        fp.chain_key(F.array(F.lit("s")), F.lit("{}")).alias("c"),
        fp.entry_size(fp.json_string(F.lit('a"b'))).alias("n"))
    row = df.first()
    assert len(row.k) == 32 and len(row.c) == 16 and row.n == 12


def trend_by_loop(rows):
    out, runs = {}, {}
    for run, t, sid, value in sorted(rows):
        runs.setdefault(run, []).append((sid, value))
    for seq in runs.values():
        for i, (sid, _) in enumerate(seq):
            last = [v for _, v in seq[max(0, i - 4):i + 1]]
            if len(last) < 5:
                out[sid] = None
                continue
            first, second = sum(last[:2]) / 2, sum(last[2:]) / 3
            out[sid] = (second - first) / first if first else None
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16, 64])
def test_trend_of_a_run_that_spans_many_ranges(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot" if rng.random() < 0.8 else f"r{rng.randint(0, 40)}", rng.randint(0, 50), i,
             float(rng.randint(0, 9))) for i in range(600)]
    df = spark.createDataFrame(rows, "run_id string, ts long, sample_id long, throughput double").withColumns(
        {"cpu": F.lit(0.1), "memory": F.lit(0.1)})
    got = {r.sample_id: r.trend for r in rp.throughput_trend(df, partitions).collect()}
    want = trend_by_loop(rows)
    assert len(got) == len(want)
    for sid, value in want.items():
        assert (got[sid] is None) == (value is None)
        if value is not None:
            assert got[sid] == pytest.approx(value)


def test_error_metrics(spark):
    df = spark.createDataFrame(
        [("WEBCRACK_FAILED", "webcrack", True), ("WEBCRACK_FAILED", "webcrack", True),
         ("FILE_NOT_FOUND", "file-input", False)], "code string, step string, recoverable boolean")
    got = {(r.scope, r.name): (r.errors, r.recoverable) for r in rp.error_metrics(df).collect()}
    assert got == {("total", "all"): (3, 2), ("step", "webcrack"): (2, 2), ("step", "file-input"): (1, 0),
                   ("code", "WEBCRACK_FAILED"): (2, 2), ("code", "FILE_NOT_FOUND"): (1, 0)}


def test_error_text(spark):
    df = spark.createDataFrame([("file-input", "File not found", ["Check path", "Try absolute path"], True),
                                ("s", "m", [], False)],
                               "step string, message string, suggestions array<string>, recoverable boolean")
    a, b = [r.text for r in rp.format_errors(df).collect()]
    assert a == ("❌ Error in file-input: File not found\n\n💡 Suggestions:\n  • Check path\n  • Try absolute path"
                 "\n\n🔄 This error is recoverable - attempting to continue...")
    assert b == "❌ Error in s: m"


def test_step_chain_recovers_stops_and_keeps_order(spark, units):
    def fails_on(word):
        return lambda code: F.when(code.contains(word), F.lit(f"found {word}"))

    steps = [rp.Step("upper", F.upper, fails_on("soft")),
             rp.Step("mark", lambda c: F.concat(c, F.lit("!")), fails_on("hard"), recoverable=False),
             rp.Step("wrap", lambda c: F.concat(F.lit("<"), c, F.lit(">")))]
    out = {r.unit_id: r for r in rp.run_steps(units(("a", "x"), ("b", "soft"), ("c", "soft hard")), steps).collect()}
    assert (out["a"].code, out["a"].ok, out["a"].warnings) == ("<X!>", True, [])
    assert out["b"].code == "<soft!>" and out["b"].warnings == ["Step 'upper' failed but was recovered: found soft"]
    assert (out["c"].code, out["c"].ok, out["c"].error.step) == ("soft hard", False, "mark")
    assert rp.run_steps(units("same"), []).first().code == "same"
    add = rp.compose(lambda d: d.withColumn("n", F.lit(1)), lambda d: d.withColumn("n", F.col("n") + 1))
    assert units("x").transform(add).first().n == 2


def test_terms_of_every_sort(spark, units):
    df = units("a a.b a$b x == y", "aa b.a $x x$ été", "")
    got = {r.term: r.n for r in ids.count_terms(df, ["a", "a.b", "$x", "zz", "x == y", "a", ""]).collect()}
    assert got == {"a": 4, "a.b": 1, "$x": 0, "zz": 0, "x == y": 1}


def test_inventory_of_a_name_that_is_everywhere(spark, units):
    df = units(*["hot hot x%d" % i for i in range(200)])
    rows = {r.identifier: (r.occurrences, r.units) for r in ids.identifier_inventory(df).collect()}
    assert rows["hot"] == (400, 200) and rows["x7"] == (1, 1) and len(rows) == 201


def test_dependency_counts(spark, units):
    df = units("require('a'); require('a'); import b from 'b'", 'import "x"; import c from "a"')
    rows = {r.module: (r.statements, r.units) for r in ft.dependency_counts(df).collect()}
    assert rows == {"a": (3, 2), "b": (1, 1)}


def test_version_metrics_of_empty_input(spark, units):
    before, after = units(("e", "")), units(("e", "ab\nc"))
    assert ft.compare_versions(before, after, "format").first().compression_ratio == 1.0
    assert ft.compare_versions(before, after, "transform").first().transformation_ratio is None
    assert ft.compare_versions(before, after, "unpack").first().size_increase is None


def test_sums_survive_values_beyond_the_exact_range(spark):
    df = spark.createDataFrame(
        [("a", 0.1), ("a", 0.2), ("b", 1e300), ("b", 1.0), ("c", float("nan")), ("d", None)],
        "name string, value double")
    got = {r.name: r["mean"] for r in rp.metric_means(df).collect()}
    assert got["a"] == 0.15 and got["b"] == 5e299 and got["c"] != got["c"] and got["d"] == 0.0


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
@pytest.mark.parametrize("share", [0.0001, 0.01, 0.3, 1.0])
def test_split_join_equals_plain_join(spark, how, share):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.4 else "gone" if rng.random() < 0.2 else f"k{rng.randint(0, 60)}")
            for i in range(2000)] + [(-1, None)]
    left = spark.createDataFrame(rows, "id long, key string")
    right = spark.createDataFrame([(f"k{i}", i) for i in range(50)] + [("hot", -5)], "key string, v long")
    got = skew.join_unique(left, right, "key", how, share)
    want = left.join(right, "key", how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_hot_keys_are_bounded_by_their_share(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(
        F.col("id").cast("string")).alias("key"))
    assert [r.key for r in skew.hot_keys(df, "key").collect()] == ["hot"]


def test_requests_that_share_a_key_are_called_once(spark):
    asked = spark.createDataFrame([("r2", "a", "p"), ("r1", "a", "p"), ("r3", "b", "q"), ("r4", "c", "z")],
                                  "request_id string, key string, prompt string")
    cache = entries(spark, [("b", 0.0, 1, 10)])
    got = sorted((r.request_id, r.key) for r in ca.calls_to_make(asked, cache, at(1)).collect())
    assert got == [("r1", "a"), ("r4", "c")]


def stored_entries(spark, rows):
    """(key, payload, created second)"""
    df = spark.createDataFrame(rows, "key string, payload string, s long")
    return df.select("key", "payload", F.timestamp_seconds("s").alias("created_at"), F.timestamp_seconds(F.col("s") + 60).alias("expires_at"),
                     F.lit(1).cast("long").alias("size"))


def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    folder = str(tmp_path / "cache")
    old = stored_entries(spark, [(f"k{i}", f"p{i}", i) for i in range(200)])
    snapshots.write_snapshot(old, folder, 32)

    def files():
        return {str(p.relative_to(tmp_path)) for p in (tmp_path / "cache").rglob("*.parquet")}
    before = files()
    fresh = stored_entries(spark, [("k7", "new", 900), ("k7", "new", 900), ("k8", "older", -5), ("added", "x", 3), (None, "no", 1)])
    touched = snapshots.upsert_snapshot(spark, folder, fresh, 32)
    assert 0 < len(touched) <= 3
    gone = {f.split("bucket=")[1].split("/")[0] for f in before - files()}
    assert gone == {str(b) for b in touched}
    got = {r.key: r.payload for r in snapshots.read_snapshot(spark, folder).collect()}
    assert got == {f"k{i}": f"p{i}" for i in range(200)} | {"k7": "new", "added": "x"}
    assert snapshots.read_snapshot(spark, folder).count() == 201
    assert snapshots.upsert_snapshot(spark, folder, fresh.limit(0), 32) == []


def test_latest_entries_sort_no_payload(spark):
    plan = snapshots.latest_entries(stored_entries(spark, [("a", "x", 1), ("a", "y", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Sort" in line and "payload" in line]
    same = stored_entries(spark, [("a", "x", 1), ("a", "y", 1), ("a", "z", 0)])
    first, again = snapshots.latest_entries(same).collect(), snapshots.latest_entries(same.orderBy("payload")).collect()
    assert first == again and len(first) == 1


def test_an_upsert_shuffles_an_entry_once(spark, tmp_path):
    plans = []

    def noted(df, place):
        out = latest(df, place)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    latest, snapshots.latest_entries = snapshots.latest_entries, noted
    try:
        old = stored_entries(spark, [(f"k{i % 40}", f"p{i}", i) for i in range(120)] + [("hot", "h", t) for t in range(60)])
        snapshots.write_snapshot(old, str(tmp_path / "cache"), 4)
    finally:
        snapshots.latest_entries = latest
    assert len(plans) == 1 and plans[0].count("Exchange") == 4  # times, hashes, outcomes, entries
    assert len(re.findall(r"Exchange hashpartitioning\(bucket#\d+, _part#", plans[0])) == 2
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    got = {r.key: r.payload for r in snapshots.read_snapshot(spark, str(tmp_path / "cache")).collect()}
    assert got == {f"k{i % 40}": f"p{i}" for i in range(80, 120)} | {"hot": "h"}
