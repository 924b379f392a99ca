from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from codecorpus.functions import classify as cl
from codecorpus.functions import lexical as lx
from codecorpus.functions import renames as fn
from codecorpus.operators import renames as op


def parse(spark, *payloads):
    rows = [(f"r{i}", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "request_id string, payload string")
    return op.parse_suggestions(df).orderBy("request_id", "ordinal").collect()


def test_array_answer_with_both_field_styles(spark):
    a, b = parse(spark, [
        {"name": "a", "newName": "userData", "confidence": 0.9, "reasoning": "Stores user data", "type": "variable"},
        {"originalName": "b", "suggestedName": "processData", "confidence": 0.8, "reason": "Processes data", "type": "function"},
    ])
    assert tuple(a)[1:] == (0, "a", "userData", 0.9, "Stores user data", "variable", None)
    assert tuple(b)[1:] == (1, "b", "processData", 0.8, "Processes data", "function", None)


@pytest.mark.parametrize("field", ["suggestions", "renames", "variablesAndFunctionsToRename"])
def test_object_answer(spark, field):
    row, = parse(spark, {field: [{"name": "x", "newName": "counter", "confidence": 0.7}]})
    assert (row.original_name, row.suggested_name, row.confidence) == ("x", "counter", 0.7)
    assert (row.reasoning, row.type) == ("", "variable")


def test_json_inside_text(spark):
    row, = parse(spark, 'Some text before [{"name":"temp","newName":"temperature","confidence":0.95}] after')
    assert (row.original_name, row.suggested_name) == ("temp", "temperature")


def test_confidence_outside_its_range_or_no_number_is_the_default(spark):
    rows = parse(spark, [{"name": "a", "newName": "b", "confidence": c} for c in (-0.5, 1.5, "invalid", None, 0, 1)])
    assert [r.confidence for r in rows] == [0.5, 0.5, 0.5, 0.5, 0.0, 1.0]


def test_types_are_lower_cased_and_checked(spark):
    rows = parse(spark, [{"name": "a", "newName": "b", "type": t} for t in ("VARIABLE", "Function", "CLASS", "odd", 3)])
    assert [r.type for r in rows] == ["variable", "function", "class", "variable", "variable"]


def test_unusable_answers_and_items_are_error_rows(spark):
    rows = parse(spark, "invalid json", "null", "123", {"other": []},
                 ["invalid-item", {"confidence": 0.8}, {"name": "a"}, {"name": 5, "newName": "b"},
                  {"name": "ok", "newName": "fine"}])
    assert [r.error for r in rows] == [
        "No JSON found in response", "No JSON found in response", "No JSON found in response",
        "Response does not contain a suggestions array",
        "Invalid suggestion at index 0", "Invalid originalName: expected non-empty string",
        "Invalid suggestedName: expected non-empty string",
        "Invalid originalName: expected non-empty string", None]
    assert rows[-1].original_name == "ok"


def test_empty_list_gives_no_row(spark):
    assert parse(spark, {"suggestions": []}, []) == []


def test_text_fallback_keeps_order_and_all(spark):
    text = "a -> b; Rename x1 to y1. c=>d " + " ".join(f"p{i}->q{i}" for i in range(30))
    df = spark.createDataFrame([("r", text)], "request_id string, payload string")
    rows = op.parse_text_fallback(df).orderBy("ordinal").collect()
    assert len(rows) == 33
    assert [(r.original_name, r.suggested_name) for r in rows[:3]] == [("x1", "y1"), ("a", "b"), ("p0", "q0")]
    assert {(r.confidence, r.type) for r in rows} == {(0.5, "variable")}


def test_first_trailing_comma_is_repaired(spark):
    df = spark.createDataFrame([('[{"a":1}, \n ] [{}, ]',)], "s string")
    assert df.select(fn.repair_trailing_comma(F.col("s"))).first()[0] == '[{"a":1}] [{}, ]'


def suggestions(spark, *rows):
    data = [("u", c, o, old, new, conf, "", "variable") for c, o, old, new, conf in rows]
    return spark.createDataFrame(
        data, "unit_id string, chunk_index long, ordinal long, original_name string, "
              "suggested_name string, confidence double, reasoning string, type string")


def test_most_confident_wins_and_first_wins_ties(spark):
    df = suggestions(spark, (1, 0, "a", "late", 0.9), (0, 1, "a", "early", 0.9), (0, 0, "a", "low", 0.5),
                     (0, 2, "b", "only", 0.1))
    got = {r.original_name: r.suggested_name for r in op.best_suggestions(df).collect()}
    assert got == {"a": "early", "b": "only"}


def test_mean_confidence_and_warnings(spark):
    df = suggestions(spark, (0, 0, "a", "x", 0.8), (0, 1, "b", "y", 0.6), (0, 2, "c", "z", 1.0))
    assert op.overall_confidence(df).first().confidence == pytest.approx(0.8)
    keys = spark.createDataFrame([("u",), ("none",)], "unit_id string")
    got = {r.unit_id: r.confidence for r in op.overall_confidence(df, all_keys=keys).collect()}
    assert got == {"u": pytest.approx(0.8), "none": 0.0}
    assert op.quality_warnings(df).first().warnings == []
    low = suggestions(spark, (0, 0, "a", "x", 0.1), (0, 1, "b", "y", 0.45))
    assert op.quality_warnings(low).first().warnings == [
        "1 suggestions excluded due to low confidence (< 30%)",
        "Average confidence is low (45.0%), consider manual review"]
    none = suggestions(spark, (0, 0, "a", "x", 0.1))
    assert op.quality_warnings(none).first().warnings[1] == (
        "Average confidence is low (0.0%), consider manual review")


def apply(spark, how, code, *renames):
    df = suggestions(spark, *[(0, i, o, n, 0.9) for i, (o, n) in enumerate(renames)])
    unit = spark.createDataFrame([("u", code)], "unit_id string, code string")
    return getattr(op, how)(unit, df).first().code


def test_free_names_are_renamed_and_other_places_are_not(spark):
    code = ("var val = obj.val; // val\nlet o = { val: val, k: c ? val : val };\n"
            "class K { val(a) { return val(a); } get val() { return 1; } }\n"
            "f(...val, 'val', \"a \\\" val\", `${val}`); /* val */ case val: xval; val$; éval; 1val; a?.val")
    want = ("var V = obj.val; // val\nlet o = { val: V, k: c ? V : V };\n"
            "class K { val(a) { return V(a); } get val() { return 1; } }\n"
            "f(...V, 'val', \"a \\\" val\", `${V}`); /* val */ case V: xval; val$; éval; 1val; a?.val")
    assert apply(spark, "apply_by_token", code, ("val", "V")) == want


def test_chain_is_followed_in_sequence_but_not_by_map(spark):
    code = "aaa + bb + c"
    renames = (("aaa", "bb"), ("bb", "cc"), ("c", "d"))
    assert apply(spark, "apply_by_token", code, *renames) == "bb + cc + d"
    # longest first: aaa becomes bb, then every bb becomes cc; one letter is left alone
    assert apply(spark, "apply_in_sequence", code, *renames) == "cc + cc + c"


def test_targets_are_taken_literally(spark):
    code = "alpha(beta)"
    assert apply(spark, "apply_in_sequence", code, ("alpha", "$1$&"), ("beta", "a\\b")) == "$1$&(a\\b)"
    assert apply(spark, "apply_by_token", code, ("alpha", "$1$&"), ("beta", "\\0")) == "$1$&(\\0)"


def test_rename_that_breaks_an_escape_is_passed_over(spark):
    code = r"var dd = /\dd/; var ee = '\nold'"
    assert apply(spark, "apply_in_sequence", code, ("ee", "name"), ("dd", "day")) == (
        r"var day = /\day/; var name = '\nold'")
    assert apply(spark, "apply_in_sequence", r"x41; '\x41'", ("x41", "alpha")) == r"x41; '\x41'"


def test_rename_everywhere_hits_keys_and_guards_reserved_words(spark):
    code = "var a = {b: b.b}; 'b'"
    assert apply(spark, "apply_everywhere", code, ("b", "first"), ("b", "class"), ("a", "z")) == (
        "var z = {class$: class$.class$}; 'b'")


def test_units_without_suggestions_stay(spark):
    unit = spark.createDataFrame([("other", "val")], "unit_id string, code string")
    df = suggestions(spark, (0, 0, "val", "x", 0.9))
    for how in ("apply_by_token", "apply_everywhere", "apply_in_sequence"):
        assert getattr(op, how)(unit, df).first().code == "val"


def test_hits_keep_renames_that_changed_nothing(spark):
    unit = spark.createDataFrame([("u", "a b a")], "unit_id string, code string")
    hits = op.rename_hits(unit, suggestions(spark, (0, 0, "a", "x", 1.0), (0, 1, "zz", "y", 1.0)))
    assert {r.original_name: r.n for r in hits.collect()} == {"a": 2, "zz": 0}
    assert tuple(op.rename_totals(hits).first())[1:] == (2, 1, 2)


@pytest.mark.parametrize("code,bad", [
    (r"'\x41'", False), (r"'é'", False), (r"/\day/", True), (r"'\n'", False), (r"\minuteUnit", True)])
def test_bad_escape(spark, code, bad):
    df = spark.createDataFrame([(code,)], "code string")
    assert df.select(cl.has_bad_escape(F.col("code"))).first()[0] is bad


def test_malformed_rows_become_errors(spark):
    df = spark.createDataFrame([("u", "a", "b"), ("u", None, "b"), ("u", "a", ""), (None, "a", "b")],
                               "unit_id string, original_name string, suggested_name string")
    good, bad = op.split_malformed(df)
    assert good.count() == 1 and bad.count() == 3


def test_dead_code_rules(spark):
    from codecorpus.functions import normalize as nm
    code = "function r() { return 1; more(); }\nfunction s() {\n  return 2;\n  never();\n}\nreturn x\n y}"
    df = spark.createDataFrame([(code,)], "code string")
    kept, dropped = df.select(nm.keep_return_line(F.col("code")), nm.drop_after_return(F.col("code"))).first()
    assert kept == code
    assert dropped == "function r() { return 1;}\nfunction s() {\n  return 2;}\nreturn x\n y}"


def in_order(code, renames):
    """The renames one after the other, as whole words."""
    for old, new in sorted(renames.items(), key=lambda r: (-len(r[0]), r[0])):
        if len(old) > 1:
            code = re.sub(rf"(?<!\w){re.escape(old)}(?!\w)", lambda _: new, code, flags=re.ASCII)
    return code


def test_chains_in_sequence_as_one_by_one(spark):
    rng = random.Random(8)
    words = ["aa", "bb", "ccc", "dddd", "ee", "f", "long_name", "x1", "zz"]
    units, rows, want = [], [], {}
    for u in range(150):
        code = "".join(rng.choice(words) + rng.choice([" ", "+", ".", "$", "(", "é", "\n", "-", ""]) for _ in range(40))
        renames = {w: rng.choice(words) for w in rng.sample(words, rng.randrange(0, 8))}
        if u % 10 == 0:
            renames["aa"] = "two words"  # no single word: goes through one by one
        units.append((f"u{u}", code))
        rows += [(f"u{u}", 0, i, o, n, 0.9, "", "variable") for i, (o, n) in enumerate(renames.items())]
        want[f"u{u}"] = in_order(code, renames)
    df = suggestions(spark)
    got = op.apply_in_sequence(spark.createDataFrame(units, "unit_id string, code string"), spark.createDataFrame(rows, df.schema))
    assert {r.unit_id: r.code for r in got.collect()} == want


def test_a_text_is_read_once_whatever_the_number_of_renames(spark):
    n = 3000
    code = " ".join(f"name{i}" for i in range(n))
    rows = [("u", 0, i, f"name{i}", f"name{i + 1}" if i % 100 else f"other{i}", 0.9, "", "variable") for i in range(n)]
    df = suggestions(spark)
    out = op.apply_in_sequence(
        spark.createDataFrame([("u", code)], "unit_id string, code string"), spark.createDataFrame(rows, df.schema)).first().code
    assert out == in_order(code, {r[3]: r[4] for r in rows})


def test_a_name_meets_its_renames_once_however_often_it_is_used(spark, monkeypatch):
    made, plain = [], op.explode_once

    def watched(*args, **how):
        made.append(plain(*args, **how))
        return made[-1]
    monkeypatch.setattr(op, "explode_once", watched)
    code = "alpha(beta + c); " * 2000
    for how in ("apply_by_token", "apply_everywhere", "apply_in_sequence"):
        assert apply(spark, how, code, ("alpha", "x"), ("beta", "y")) == "x(y + c); " * 2000
    assert max(rows.count() for rows in made) <= 6


@pytest.mark.parametrize("few", [0, 64])
def test_names_are_placed_alike_by_list_and_by_search(spark, monkeypatch, few):
    monkeypatch.setattr(lx, "FEW", few)
    rng = random.Random(3)
    toks = [rng.choice(["aa", "b", "c1", " ", "(", "dd", "é"]) for _ in range(300)]
    found = [(n, n.upper() if n != "b" else None) for n in ("aa", "b", "c1", "missing", "é")]
    df = spark.createDataFrame([(toks, found), ([], found)], "t array<string>, f array<struct<name:string,new:string>>")
    got = [[tuple(h) for h in r[0]] for r in df.select(lx.placed(F.col("t"), F.col("f"))).collect()]
    new = dict(found)
    assert got == [[(i, t, new[t]) for i, t in enumerate(toks) if t in new], []]


def test_brackets_passed_over_leave_the_enclosing_one(spark):
    deep = "{" * 12 + "(" * 600 + ")" * 600 + "}" * 12  # deeper than what is passed over together, more than a block
    code = f"f({{ a, b: [{deep}], val, ...g(() => {{ {deep} val }}) }}); class K {{ val(x = {{ y: {deep} }}) {{ }} }} {deep} {{ val }}"
    assert apply(spark, "apply_by_token", code, ("val", "V")) == (
        f"f({{ a, b: [{deep}], val: V, ...g(() => {{ {deep} V }}) }}); class K {{ val(x = {{ y: {deep} }}) {{ }} }} {deep} {{ V }}")
