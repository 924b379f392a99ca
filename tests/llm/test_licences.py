"""Licence scans: base places by regular expressions, matches and chains by brute force."""

from __future__ import annotations

import random
import re

import pytest

from codecorpus.llm import licences, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def base_places(text):
    words = WORD.findall(lower(text))
    return len(words), sorted((label, i) for p, label in BASE.items() for i in range(len(words)) if tuple(words[i:i + len(p)]) == p)


def longest_matches(words, template, least):
    """All maximal runs shared by two lists of words: (start, start in the template, length)."""
    out = []
    for i in range(len(words)):
        for j in range(len(template)):
            if words[i] != template[j] or (i and j and words[i - 1] == template[j - 1]):
                continue
            n = 0
            while i + n < len(words) and j + n < len(template) and words[i + n] == template[j + n]:
                n += 1
            if n >= least:
                out.append((i, j, n))
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_matches_as_by_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(licences, "TILE", rng.choice([1, 7, 50, 1 << 19]))
    letters = "abc"[:rng.randrange(1, 4)]
    least = rng.randrange(1, 5)
    templates = [("t", " ".join(rng.choices(letters, k=rng.randrange(1, 14)))) for _ in range(rng.randrange(1, 5))]
    phrases = [("p", " ".join(rng.choices(letters, k=rng.randrange(1, 4)))) for _ in range(rng.randrange(0, 3))]
    text = " ".join(rng.choices(letters + "xX", k=rng.randrange(0, 80)))
    tool = licences.Scanner(phrases, templates, least, 5, 0.5)
    n, wholes, found = tool.matches(licences.tiles(text.encode()))
    words = text.lower().split()
    assert n == len(words)
    named = [p.split() for _, p in phrases + templates]
    exact = [k for k, w in enumerate(named) if k < len(phrases) or len(w) < least]
    assert sorted(wholes) == sorted((k, i) for k in exact for i in range(len(words)) if words[i:i + len(named[k])] == named[k])
    assert sorted(found) == sorted(
        (k, *m) for k, w in enumerate(named) if k not in exact for m in longest_matches(words, w, least))


@pytest.mark.parametrize("seed", range(10))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    sequences = [rng.choices([b"a", b"b", b"c"], k=rng.randrange(1, 12)) for _ in range(4)]
    auto = licences.Automaton(sequences, 2)
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text, state, length = rng.choices([b"a", b"b", b"c"], k=60), 0, 0
    for i, w in enumerate(text):
        if w not in auto.ids:
            state, length = 0, 0
        else:
            state, length = auto.step(state, length, auto.ids[w])
        assert length == max((k for k in range(1, i + 2) if tuple(text[i + 1 - k:i + 1]) in runs), default=0)


def best_cover(own, gap):
    """Highest cover of any chain, by trying all."""
    def follow(i):
        s, t, n = own[i]
        return n, [(j, own[j][2] + min(0, min(own[j][0] - s, own[j][1] - t) - n)) for j in range(len(own))
                   if own[j][0] > s and own[j][1] > t and max(own[j][0] - s, own[j][1] - t) - n <= gap]

    def best(i):
        return max((gain + best(j) for j, gain in follow(i)[1] if gain > 0), default=0)
    return max((own[i][2] + best(i) for i in range(len(own))), default=0)


@pytest.mark.parametrize("seed", range(20))
def test_best_chain(seed):
    rng = random.Random(seed)
    template = rng.choices("abcdefgh", k=14)
    words = [w for w in template if rng.random() < .85] + rng.choices("abcdefgh", k=6)
    tool = licences.Scanner((), [("t", " ".join(template))], 2, 3, 0.5)
    found = tool.matches([[w.encode() for w in words]])[2]
    chains = tool.chains(found)
    assert max((c[3] for c in chains), default=0) == best_cover([m[1:] for m in found], 3) <= len(template)


def test_notices_in_texts():
    tool = licences.Scanner(licences.PHRASES, licences.TEMPLATES, 3, 12, 0.7)

    def labels(text):
        _, phrases, spans, score = tool.scan(licences.tiles(text.encode()))
        return {p["label"] for p in phrases} | {s["label"] for s in spans}, score
    assert labels("x. Released under the MIT License. y") == ({"mit"}, 1.0)
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ({"gpl", "gpl-3.0"}, 1.0)
    assert labels("Licensed under CC BY-NC 4.0.") == ({"cc-by", "cc-by-nc"}, 1.0)
    assert labels("licensed under the Apache License, Version 2.0") == ({"apache-2.0"}, 1.0)
    assert labels("All Rights\n * Reserved") == ({"reserved"}, 1.0)
    assert labels("nothing of the sort, or with or without it")[0] == set()
    long = dict(licences.TEMPLATES[2:3])["mit"]
    changed = long.replace("free of charge", "gratis").replace("Software", "Program", 1).replace("copy, modify", "copy and modify")
    got, score = labels("Foo " + changed + " bar")
    assert got == {"mit"} and 0.7 < score < 1
    _, _, spans, _ = tool.scan(licences.tiles(f"a {long} b {long}".encode()))
    assert [(s["template"], s["coverage"]) for s in spans] == [(2, 1.0), (2, 1.0)]
    size = len(licences.words_of(long))
    assert [(s["first"], s["last"]) for s in spans] == [(1, size), (size + 2, 2 * size + 1)]
    with pytest.raises(ValueError):
        licences.Scanner((), [("t", "--")], 3, 12, 0.7)


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    parts = ["cc", "by", "CC BY", "General", "public", "license", "all", "rights", "reserved", "x", "-", "\n", "é", "İ", "\x00", "K"]
    texts = [None, "", "  ", "cc", "ccby", "cc-by", "Cc_By cc.by", "all rights reserved " * 30_000, "w " * 400_000] + [
        " ".join(rng.choices(parts, k=rng.randrange(0, 30))) for _ in range(400)]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(None, "cc by", "s", 1), (3, "cc by", "s", 1), (3, "cc by", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, phrases string, score int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_licence_automaton(spark, str(tmp_path)).collect()
    want = []
    for i, t, *_ in rows:
        n, places = base_places(t)
        starts = [s for _, s in places]
        want.append((i, n, len(places), min(starts, default=None), max(starts, default=None),
                     ",".join(sorted({p for p, _ in places}))))
    key = repr
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key) == \
        sorted(want, key=key)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert licences.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_finds_the_notices_of_the_given_texts(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op13_licence_automaton(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        n, places = base_places(t)
        assert (got[d]["n_words"], got[d]["n_base"]) == (n, len(places))
        labels = set(got[d]["labels"].split(",")) - {""}
        assert ("mit" in labels) == ("Released under the MIT License" in t)
        assert ("apache-2.0" in labels) == ("Licensed under the Apache License, Version 2.0" in t)
        assert bool(labels) == any(x in t for x in ("icensed under", "MIT License", "All rights reserved"))
