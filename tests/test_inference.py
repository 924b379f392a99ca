from __future__ import annotations

import uuid
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from codecorpus.functions import classify as cl
from codecorpus.functions import prompts as pr
from codecorpus.operators import cache as ca
from codecorpus.operators import chunking as ck
from codecorpus.operators import inference as inf
from codecorpus.operators import renames as rn
from codecorpus.sources import catalog as cat
from codecorpus.streaming.calls import answer_stream


def no_wait(_):
    pass


def requests(spark, *prompts):
    rows = [(f"r{i}", p) for i, p in enumerate(prompts)]
    return spark.createDataFrame(rows, "request_id string, prompt string")


def scripted():
    seen = {}

    def call(request):
        p = request["prompt"]
        seen[p] = seen.get(p, 0) + 1
        if p == "once" and seen[p] < 2:
            raise RuntimeError("Temporary failure")
        if p == "always":
            raise RuntimeError("Persistent failure")
        if p in ("Unauthorized", "Invalid API key", "Quota exceeded", "Bad request"):
            raise RuntimeError(p)
        return f"answer to {p}", 100

    return call


def test_attempts_and_error_classes(spark):
    df = requests(spark, "fine", "once", "always", "Unauthorized", "Invalid API key", "Quota exceeded", "Bad request")
    rows = {r.request_id: r for r in inf.run_inference(df, scripted, sleep=no_wait).collect()}
    got = [(rows[f"r{i}"].attempts, rows[f"r{i}"].error_class) for i in range(7)]
    assert got == [(1, None), (2, None), (3, "exhausted")] + [(1, "non_retryable")] * 4
    assert rows["r0"].payload == "answer to fine" and rows["r0"].tokens_used == 100
    assert rows["r2"].payload is None and rows["r2"].error_message == "Persistent failure"


def test_back_off_doubles_with_bounded_jitter():
    waits = []
    row = inf._call(scripted(), {"request_id": "r", "prompt": "always"}, 4, 1.0, waits.append)
    assert row["attempts"] == 4 and len(waits) == 3
    for wait, base in zip(waits, (1, 2, 4), strict=True):
        assert base <= wait <= base * 1.1


def test_threads_and_partitions_keep_every_request(spark):
    df = requests(spark, *[f"p{i}" for i in range(50)])
    out = inf.run_inference(df, scripted, partitions=4, threads=3, sleep=no_wait)
    assert sorted(r.payload for r in out.collect()) == sorted(f"answer to p{i}" for i in range(50))


def test_answers_come_in_batches_by_number_and_time():
    rows = [{"request_id": str(i), "payload": "x", "tokens_used": 1} for i in range(50)]
    assert [len(f) for f in inf._gathered(iter(rows), 20, 60)] == [20, 20, 10]
    assert [len(f) for f in inf._gathered(iter(rows), 20, 0)] == [1] * 50  # no answer waits for another
    assert list(inf._gathered(iter([]), 20, 60)) == []


def counted(folder, stop_at=None):
    """A client that notes each call in a file of its own and may take the whole run down."""
    def make():
        def call(request):
            p = request["prompt"]
            if p == stop_at:
                raise SystemExit("lost")
            (folder / f"{p}-{uuid.uuid4().hex}").touch()
            if p.startswith("never"):
                raise RuntimeError("Unauthorized")
            if p.startswith("busy"):
                raise RuntimeError("Server error")
            return f"answer to {p}", 1
        return call
    return make


def calls(folder):
    return Counter(p.name.split("-")[0] for p in folder.iterdir())


def test_a_stopped_run_is_taken_up_again(spark, tmp_path):
    asked, log, check, noted = (tmp_path / d for d in ("asked", "log", "cp", "calls"))
    noted.mkdir()
    for k in range(4):  # four files, so four batches
        names = [f"p{k}{i}" for i in range(5)] + [f"never{k}", f"busy{k}"]
        rows = [(f"r{n}", n) for n in names]
        spark.createDataFrame(rows + rows[:1], "request_id string, prompt string").coalesce(1).write.mode("append").parquet(str(asked))

    def run(client, checkpoint):
        stream = spark.readStream.schema("request_id string, prompt string").option("maxFilesPerTrigger", 1).parquet(str(asked))
        q = answer_stream(stream, str(log), checkpoint, client, sleep=no_wait, max_attempts=1)
        q.awaitTermination(180)

    with pytest.raises(StreamingQueryException):
        run(counted(noted, stop_at="p22"), str(check))
    stored = {r.request_id for r in spark.read.parquet(str(log)).filter("payload is not null").collect()}
    assert 5 <= len(stored) < 20
    run(counted(noted), str(check))
    assert all(calls(noted)[s[1:]] == 1 for s in stored)  # no stored call is repeated
    answered = {r.request_id for r in spark.read.parquet(str(log)).filter("payload is not null").collect()}
    assert answered == {f"rp{k}{i}" for k in range(4) for i in range(5)}
    before = calls(noted)
    run(counted(noted), str(tmp_path / "other"))  # a new checkpoint over the same log
    again = {n for n, c in calls(noted).items() if c > before[n]}
    assert again == {f"busy{k}" for k in range(4)}  # what may still be answered


def test_repeated_tasks_leave_one_response_per_request(spark):
    out = inf.run_inference(requests(spark, "fine", "always"), scripted, sleep=no_wait)
    twice = inf.latest_responses(out.unionByName(out))
    assert twice.count() == 2
    failed = out.withColumn("payload", F.lit(None).cast("string"))
    best = {r.request_id: r.payload for r in inf.latest_responses(out.unionByName(failed)).collect()}
    assert best["r0"] == "answer to fine"


def test_prompt_states_the_facts(spark):
    code = "function test() {\n  const a = 1;\n  const b = 2;\n  return a + b;\n}"
    df = spark.createDataFrame([(code,)], "code string")
    text = df.select(pr.full_prompt(F.col("code"), F.lit("ollama"))).first()[0]
    for part in ("JavaScript developer", "variable and function names", "camelCase", "confidence scores",
                 "Lines: 5", f"Characters: {len(code)}", "Estimated complexity: low", code, "JSON"):
        assert part in text


@pytest.mark.parametrize("provider,size,cheap,model", [
    ("anthropic", 5000, False, "claude-3-5-haiku-20241022"),
    ("anthropic", 25000, False, "claude-3-5-sonnet-20241022"),
    ("anthropic", 75000, False, "claude-3-opus-20240229"),
    ("anthropic", 25000, True, "claude-3-5-haiku-20241022"),
    ("openai", 3000, False, "gpt-4o-mini"), ("openai", 5000, False, "gpt-4o"),
    ("azure", 20000, False, "gpt-4-turbo"), ("ollama", 5000, False, "codellama:13b"),
    ("ollama", 50000, True, "codellama:34b"), ("unsupported", 1, False, None),
])
def test_routing(spark, provider, size, cheap, model):
    df = spark.createDataFrame([(provider, size, cheap)], "p string, s long, c boolean")
    row = inf.route_models(df, F.col("p"), F.col("s"), F.col("c")).first()
    assert row.recommended_model == model
    assert set(row.asDict()) == {"p", "s", "c", "recommended_model"}


def test_limits_fall_back_to_family_and_default(spark):
    rows = [("openai", "gpt-4o"), ("openai", "new"), ("ollama", "llama3:8b"), ("ollama", "codellama:70b"),
            ("ollama", "new:1b"), ("anthropic", "new"), ("azure", "gpt-4")]
    df = spark.createDataFrame(rows, "provider string, model string")
    got = {(r.provider, r.model): r.token_limit for r in inf.token_limits(df).collect()}
    assert [got[r] for r in rows] == [128000, 8192, 128000, 16384, 4096, 200000, 8192]


def test_costs(spark):
    df = spark.createDataFrame(
        [("anthropic", "claude-3-5-sonnet-20241022"), ("openai", "gpt-4o"), ("openai", "unknown"), ("ollama", "x")],
        "provider string, model string").withColumns({"input_tokens": F.lit(1000), "output_tokens": F.lit(500)})
    got = [r.cost for r in inf.request_costs(df).collect()]
    assert got == pytest.approx([0.0105, 0.0125, 0.0125, 0.0])
    load = spark.createDataFrame([(1000, 500)], "input_tokens long, output_tokens long")
    both = {r.provider: r.cost for r in inf.compare_costs(load).collect()}
    assert both == pytest.approx({"anthropic": 0.0105, "openai": 0.0125})


def test_usage_of_idle_providers_is_zero(spark):
    df = spark.createDataFrame([("a", 10), ("a", 15)], "provider string, tokens_used long")
    assert inf.provider_usage(df.limit(0)).count() == 0
    got = {r.provider: tuple(r)[1:] for r in inf.provider_usage(df, ["a", "b"]).collect()}
    assert got == {"a": (2, 25, 13), "b": (0, 0, 0)}


def test_specialised_models_are_dropped_and_families_ranked(spark):
    names = ["gpt-4", "o4-mini", "gpt-4o", "gpt-3.5-turbo-instruct", "tts-1", "x", "gpt-4", "", "gpt-4-0613"]
    df = spark.createDataFrame([(n,) for n in names], "model string")
    assert [r.model for r in cat.ranked_models(df).collect()] == ["o4-mini", "gpt-4o", "gpt-4", "x"]


def settings(spark, **change):
    base = {"provider": "anthropic", "model": "claude-3-5-sonnet-20241022", "api_key": "test-key",
            "base_url": None, "temperature": 0.3, "max_tokens": 8192} | change
    df = spark.createDataFrame([tuple(base.values())], "provider string, model string, api_key string, "
                               "base_url string, temperature double, max_tokens long")
    from codecorpus.operators.classify import validate_settings
    return validate_settings(df).first()


def test_settings_checks(spark):
    assert settings(spark).valid and settings(spark).errors == []
    bad = settings(spark, provider="unsupported", model="some-model", api_key=None)
    assert not bad.valid and "Unsupported provider: unsupported" in bad.errors
    assert settings(spark, model="invalid-model").errors == ["Model 'invalid-model' not available for anthropic"]
    assert settings(spark, api_key="").errors == ["API key required for anthropic"]
    assert settings(spark, provider="azure", model="gpt-4o").errors == [cl.MSG_AZURE_URL]
    local = settings(spark, provider="ollama", model="llama3:8b", api_key=None)
    assert local.valid and local.warnings == [cl.WARN_OLLAMA_URL]
    assert settings(spark, temperature=5.0).errors == [cl.MSG_TEMPERATURE]
    assert settings(spark, max_tokens=300000).errors == [cl.MSG_MAX_TOKENS]
    hot = settings(spark, temperature=1.5, max_tokens=150000)
    assert hot.valid and hot.warnings == [cl.WARN_TEMPERATURE, cl.WARN_MAX_TOKENS]


def test_whole_way_from_units_to_renamed_text(spark, units):
    """Chunks, cache misses only, calls, parsing, consolidation and application."""
    src = units(("one", "var a = 1;\n" * 30 + "use(a.a);"), ("two", "let b = 2;"))
    chunks = ck.overlap_chunks(src, 100, 10)
    reqs = inf.build_requests(chunks, F.lit("openai"), F.lit("gpt-4o")).withColumn(
        "key", F.left(F.sha2("prompt", 256), F.lit(32)))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def client():
        def call(request):
            old = "b" if "let b" in request["prompt"] else "a"
            return f'[{{"name":"{old}","newName":"{old}Name","confidence":0.{5 + request["chunk_index"] % 4}}}]', 10
        return call

    cached = reqs.filter("unit_id = 'two'").select(
        "key", F.lit('{"renames":[{"from":"b","to":"cached"}]}').alias("payload"))
    cache = ca.make_entries(cached, now)
    misses = ca.cache_misses(reqs, cache, now)
    assert {r.unit_id for r in misses.collect()} == {"one"}
    fresh = inf.run_inference(misses, client, sleep=no_wait).select("request_id", "payload")
    known = ca.cache_hits(reqs, cache, now).select("request_id", F.col("cached_payload").alias("payload"))
    answers = rn.parse_with_fallback(fresh.unionByName(known))
    suggestions = answers.join(reqs.select("request_id", "unit_id", "chunk_index"), "request_id")
    done = {r.unit_id: r.code for r in rn.apply_by_token(src, suggestions).collect()}
    assert done == {"one": "var aName = 1;\n" * 30 + "use(aName.a);", "two": "let cached = 2;"}
