"""Names in script text, on plain strings."""

from __future__ import annotations

import random
import time

import pytest

from pyspark.sql import functions as F

from codecorpus.functions import lexical
from codecorpus.functions.text import let

from . import plain_scan as scan


@pytest.mark.parametrize("code,want", [
    ("`the val is ${val} or ${ {val} } val`", "`the val is ${V} or ${ {val: V} } val`"),
    ("`${`val ${val}`} val`; val", "`${`val ${V}`} val`; V"),
    ("o = { val }; p = { a, val, b }", "o = { val: V }; p = { a, val: V, b }"),
    ("const { val } = x; const { val = 1, ...r } = y", "const { val: V } = x; const { val: V = 1, ...r } = y"),
    ("import { val } from 'm'; export { val }", "import { val as V } from 'm'; export { V as val }"),
    ("o = { a: 1, /* c */ val: 2, // d\n val: 3 }", "o = { a: 1, /* c */ val: 2, // d\n val: 3 }"),
    ("class K { val(a = f(), b = (1)) { return val } }", "class K { val(a = f(), b = (1)) { return V } }"),
    ("class K { val(" + ", ".join(f"p{i}" for i in range(90)) + ") {} }",
     "class K { val(" + ", ".join(f"p{i}" for i in range(90)) + ") {} }"),
    ("{ val(a); } function f(a, val, b) { var c, val, d }", "{ V(a); } function f(a, V, b) { var c, V, d }"),
    ("a . /* c */ val; a?.val; f(...val)", "a . /* c */ val; a?.val; f(...V)"),
    ("'val' + \"val\" // val", "'val' + \"val\" // val"),
    ("`val", "`val"), ("`${val", "`${V"), ("'val", "'V"), ("} val", "} V"), ("", ""),
])
def test_rename(code, want):
    assert scan.rename(code, {"val": "V"})[0] == want
    assert "".join(t for _, t in scan.tokens(code)) == code


def test_counts_are_of_changes():
    assert scan.rename("val.val = { val: val }; 'val'", {"val": "V", "x": "Y"})[1] == {"val": 2}


def test_every_name_but_no_template_words():
    assert scan.rename_all("val.val = `val ${val}` // val", {"val": "V"}) == "V.V = `val ${V}` // val"


def test_many_names_in_a_long_text():
    start = time.time()
    code = " ".join(f"n{i % 4000} = f(n{i});" for i in range(20_000))
    assert scan.rename(code, {f"n{i}": f"m{i}" for i in range(4000)})[1]["n7"] == 6
    assert time.time() - start < 10


def renamed(spark, codes, new="V", names=("val",), pick=lexical.free_hits):
    """Each code with some names replaced, through the columns."""
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i long, code string")

    def changed(toks):
        placed = F.transform(toks, lambda t, i: F.struct(i.alias("pos"), t.alias("name"), F.lit(new).alias("new")))
        hits = F.filter(placed, lambda x: x["name"].isin(*names)).cast(lexical.HITS)
        out = let(hits, lambda h: let(pick(toks, h), lambda c: lexical.replaced(toks, c)))
        return F.struct(F.array_join(toks, "").alias("same"), out.alias("out"))
    rows = df.select("i", let(lexical.tokens(F.col("code")), changed).alias("r")).orderBy("i").collect()
    assert [r.r.same for r in rows] == list(codes)
    return [r.r.out for r in rows]


CASES = [p for m in test_rename.pytestmark for p in m.args[1]]


def test_columns_rename_as_the_plain_version(spark):
    assert renamed(spark, [c for c, _ in CASES]) == [w for _, w in CASES]


SOUP = ["val", "val", "x", "y1", "$", " ", " ", "\n", ".", ",", ":", "=", "{", "}", "(", ")", "[", "]", ";", "...", "=>", "'", '"', "\\",
        "`", "${", "//", "/*", "*/", "/", "return", "import", "export", "const", "async", "get", "é", "?", "'val'", '"val"', "`val`",
        "`a ${val} b`", "{ val }", "f(val)", "val(a) {", "`${`${val}`}`"]


def test_columns_on_token_soup(spark):
    """All but templates that are never closed, which the columns read as code."""
    rng = random.Random(4)
    codes = ["".join(rng.choices(SOUP, k=rng.randrange(0, 40))) for _ in range(4000)]
    closed = [c for c in codes if not open_template(c)]
    assert len(closed) > 2000
    got = renamed(spark, closed)
    want = [scan.rename(c, {"val": "V"})[0] for c in closed]
    assert [(c, g, w) for c, g, w in zip(closed, got, want) if g != w] == []
    everywhere = renamed(spark, closed, pick=lambda toks, hits: hits, names=("val", "x"))
    assert everywhere == [scan.rename_all(c, {"val": "V", "x": "V"}) for c in closed]


def open_template(code):
    """Whether a template, or the code in one, is still open at the end of a text."""
    depth = 0
    inside = False
    for kind, text in scan.tokens(code):
        inside = False
        if kind == scan.TEXT and text.startswith("`") and (len(text) == 1 or not text.endswith("`")):
            depth += 1
        elif kind == scan.TEXT and depth and text.endswith("`") and not text.startswith(("'", '"')):
            depth -= 1 if not (text.startswith("`") and len(text) > 1) else 0
    return depth > 0 or inside


def test_long_texts_are_linear(spark):
    n = 60_000
    code = " ".join(f"n{i % 4000} = f(n{i}, {{ val, b: [val] }});" for i in range(n)) + '"' + "\\n" * 100_000 + '"' \
        + "`" + "${val} \\` " * 20_000 + "`" + "(" * 3000 + ")" * 3000
    start = time.time()
    out, = renamed(spark, [code])
    assert out.count("val: V") == n and out.count("[V]") == n and out.count("${V}") == 20_000
    assert time.time() - start < 60
