from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from codecorpus.functions import chunks as ch
from codecorpus.functions import classify as cl
from codecorpus.functions import features as ft
from codecorpus.functions import text as tx
from codecorpus.operators.classify import detect_dialect

EXPLICIT_B = (r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def test_identifier_pattern_equals_the_spelled_out_boundaries(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1_$ é.") for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "code string")
    explicit = EXPLICIT_B + "[a-zA-Z_$][a-zA-Z0-9_$]*" + EXPLICIT_B
    rows = df.select(
        "code", tx.identifiers(F.col("code")).alias("fast"),
        F.regexp_extract_all("code", F.lit(explicit), F.lit(0)).alias("slow")).collect()
    ascii_re = re.compile(r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b", re.ASCII)
    for r in rows:
        assert list(r.fast) == list(r.slow) == ascii_re.findall(r.code), r.code


@pytest.mark.parametrize("name", ["val", "$x", "x$", "a.b", "a\\Eb", "x == y", "é"])
def test_column_and_literal_whole_word_patterns_agree(spark, name):
    texts = [f"({name})", f"x{name}", f"{name}x", f" {name} {name}", f"{name}{name}", f"1{name}$", name]
    df = spark.createDataFrame([(t, name) for t in texts], "code string, name string")
    rows = df.select(
        "code",
        F.regexp_count("code", tx.whole_word_pattern(F.col("name"))).alias("a"),
        F.regexp_count("code", F.lit(tx.whole_word_regex(name))).alias("b")).collect()
    expected = re.compile(rf"\b{re.escape(name)}\b", re.ASCII)
    for r in rows:
        assert r.a == r.b == len(expected.findall(r.code)), (name, r.code)


def test_brace_depth(spark, units):
    df = units("", "{}", "{{}}{", "}}{{{", "a{b{c}d}e{f}", "}")
    got = [r.d for r in df.select(ft.brace_depth(F.col("code")).alias("d")).collect()]
    assert got == [0, 1, 2, 1, 2, 0]


def test_counts_of_functions_and_variables(spark, units):
    code = "function f(){}\nlet a = function g(){}, o = { k: function(){} };\nconst h = () => {};"
    row = units(code).select(
        ft.function_count(F.col("code")).alias("n"), ft.function_count_full(F.col("code")).alias("m"),
        ft.variable_count(F.col("code")).alias("v"), ft.line_count(F.col("code")).alias("l"),
        ft.token_estimate(F.col("code")).alias("t")).first()
    # f, g, k and the arrow; the assigned g counts once more in the full count
    assert (row.n, row.m, row.v, row.l, row.t) == (4, 5, 2, 3, -(-len(code) // 4))


def test_prompt_complexity_label(spark, units):
    bodies = ["const a = 1;"] + [
        "\n".join(f"function func{i}() {{ return {i}; }}" for i in range(n)) for n in (20, 60)]
    rows = units(*bodies).select(ft.complexity_label(
        ft.line_count(F.col("code")), ft.function_words(F.col("code"))).alias("label")).collect()
    assert [r.label for r in rows] == ["low", "medium", "high"]


def test_dialect_by_extension_then_syntax(spark):
    rows = [("a.TSX", ""), ("a.jsx", "interface A"), ("a.js", "let a: number = 1"),
            ("a.js", "<div>"), ("a.js", "<!-- <p> -->"), ("a.js", "a<b && c"), ("a.js", "if (a<b) {} c>d")]
    df = spark.createDataFrame(rows, "path string, code string")
    got = detect_dialect(df.withColumn("unit_id", F.lit("u"))).collect()
    assert [(g.dialect, g.rule) for g in got] == [
        ("typescript", "extension"), ("babel", "extension"), ("typescript", "typed_syntax"),
        ("typescript", "typed_syntax"), ("typescript", "typed_syntax"), ("babel", "default"),
        ("babel", "markup_syntax")]


def test_markup_check_equals_its_plain_pattern(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("<>/a -!\n") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "code string")
    plain = re.compile(r"(<\w+[^>]*>|</\w+>)", re.ASCII)
    for r in df.select("code", cl.has_markup_syntax(F.col("code")).alias("m")).collect():
        want = bool(plain.search(r.code)) and not r.code.strip(" \n").startswith("<!--")
        assert r.m == want, repr(r.code)


def test_long_patterns_do_not_exhaust_the_stack(spark, units):
    union = "let a: " + " | ".join(f"T{i}" for i in range(20_000)) + " = 1"
    row = units(("a", union)).select(F.max(cl.has_typed_syntax(F.col("code"))).alias("typed")).first()
    assert row.typed


def chunks_by_loop(code, size, overlap):
    keep, start, out = size * 4 // 5, 0, []
    while True:
        end = min(start + size, len(code))
        if end < len(code):
            for i in range(end, start + keep, -1):
                if code[i] in "\n;})":
                    end = i + 1
                    break
        out.append((start, end))
        if end >= len(code):
            return out
        start = end - overlap


def cuts_by_loop(code, size):
    keep, pos, out = -(-size * 4 // 5), 0, []
    while len(code) - pos >= size:
        end = pos + size
        for i in range(size - 1, keep - 1, -1):
            if code[pos + i] in "\n;})":
                end = pos + i + 1
                break
        out.append((pos, end))
        pos = end
    return out + ([(pos, len(code))] if pos < len(code) or not code else [])


@pytest.mark.parametrize("size,overlap", [(10, 1), (10, 7), (37, 5), (100, 10), (5, 0)])
def test_chunks_equal_a_plain_loop(spark, size, overlap):
    rng = random.Random(size * 100 + overlap)
    texts = ["".join(rng.choices("ab;}\né𝒳", weights=(20, 20, 1, 1, 1, 3, 1), k=rng.randint(0, 400)))
             for _ in range(300)] + ["", "x" * size, "x" * (size + 1), ";" * (3 * size)]
    df = spark.createDataFrame([(t,) for t in texts], "code string").select(
        "code", ch.overlap_chunks(F.col("code"), size, overlap).alias("o"),
        ch.boundary_chunks(F.col("code"), size).alias("b"),
        ch.fixed_chunks(F.col("code"), size).alias("f"))
    for r in df.collect():
        assert [(c.start, c.end) for c in r.o] == chunks_by_loop(r.code, size, overlap)
        assert [(c.start, c.end) for c in r.b] == cuts_by_loop(r.code, size)
        assert "".join(c.text for c in r.b) == "".join(c.text for c in r.f) == r.code
        assert all(c.text == r.code[c.start:c.end] for c in [*r.o, *r.b, *r.f])


def test_token_chunks_cover_the_text(spark):
    texts = ["", "x", "y" * 1599, "z" * 1600, "é" * 1601, "ab" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "code string").select(
        "code", ch.token_chunks(F.col("code"), 1600).alias("c"))
    for r in df.collect():
        at, want = 0, []
        while at < len(r.code):
            want.append((at, min(at + 1600, len(r.code))))
            if at + 1600 >= len(r.code):
                break
            at += 1280
        want = want or [(0, 0)]
        assert [(c.start, c.end) for c in r.c] == want
        assert all(c.text == r.code[c.start:c.end] for c in r.c)
