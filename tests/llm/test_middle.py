"""Fill-in-middle against a plain version by regular expressions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from codecorpus.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABET = [" ", " ", "\t", "\n", "\x0b", "\r", "a", "b", "é", "日", "\U0001F600", "\x00", "\x08", "\x0e", "\x1f", "\xa0",
            "\x7f", "\x89", "\x8d", "!"]


def plain_version(key, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(rng, n):
    out = [None, "", " ", "\n\n", "a", "a ", " a", "<P>", "x <M> y", "<", ">", "<P", "<S a> b", "a " * 7, "é" * 8, "abcdefgh",
           "abcdefg ", "a" * 300_000, "word \n" * 60_000, "é日 " * 40_000]
    while len(out) < n:
        out.append("".join(rng.choices(ALPHABET, k=rng.randrange(0, 40))))
    return out


def test_every_text_as_in_the_plain_version(spark):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng, 3000))) + [(None, "a b c"), (None, "a b c"), (7, "d e f g"), (-3, "x y z")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, output string, n int")
    out = middle.fill_in_middle(docs)
    got = out.select("*", middle.restored(out["output"], out["form"]).alias("back")).collect()
    want = sorted(((k, *plain_version(k, t), t or "") for k, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("size", range(0, 20))
def test_ends_of_short_texts(size):
    rng = random.Random(size)
    some = ["".join(rng.choices(ALPHABET, k=size)) for _ in range(200)]
    raw = [t.encode() for t in some]
    zero = np.zeros(len(raw), np.int64)
    n = middle.cuts(raw, zero, zero)[0]
    assert n.tolist() == [len(UNIT.findall(t)) for t in some]
    for k in range(int(n.max()) + 1):
        # the remainder of n + 1 + k by n + 1 is k wherever there are so many units
        _, at, points, *_ = middle.cuts(raw, np.minimum(k, n), n)
        for t, a, p, units in zip(some, at, points, map(UNIT.findall, some), strict=True):
            assert (a, p) == (len("".join(units[:k]).encode()), len("".join(units[:k])))


def test_other_seeds_rates_and_marks(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c <P> d") for i in range(200)], "k long, body string")
    out = middle.fill_in_middle(docs, "k", "body", seed=7, percent=100, percent_spm=0, marks=("[p", "[s", "[m"))
    rows = out.select("*", middle.restored(out["output"], out["form"], ("[p", "[s", "[m")).alias("back")).collect()
    assert {r["form"] for r in rows} == {"psm"} and all(r["back"] == f"a{r['k']} b c <P> d" for r in rows)
    assert out.columns[0] == "k"
    for bad in (("a", "a", "b"), ("ab", "ba", "c"), ("", "x", "y"), ("<P", "<P<", "<M")):
        with pytest.raises(ValueError):
            middle.fill_in_middle(docs, "k", "body", marks=bad)


def test_empty_table_and_text_keys(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = middle.fill_in_middle(spark.createDataFrame([("id", "a b c")], "doc_id string, text string")).collect()[0]
    assert tuple(row)[1:] == plain_version("id", "a b c")
