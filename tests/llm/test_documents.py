"""The operators on documents against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codecorpus.llm import graph, lm, minhash, packing, quality, repeats, textbytes, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, texts, schema=SCHEMA):
    return spark.createDataFrame(
        [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = prose(rng, 120)
    texts = [prose(rng, rng.randrange(1, 150)) for _ in range(30)]
    texts += [base, base, base.upper(), base.replace("w1", "x1"), base + " tail", None, "", "   ", "a b", "a b"]
    words = base.split()
    for _ in range(25):
        w = words[:]
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += ["é" * 260, "x" * 900, "ab" * 400, texts[0] + base, "\t" + prose(rng, 4000), "ñ " * 150]
    return texts


def word_list(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_words_equal_the_pattern(corpus):
    import pyarrow as pa
    view, offsets = textbytes.texts_of(pa.array(corpus))
    hashes, at = textbytes.words(view, offsets, 0, len(corpus))
    seen, back = {}, {}
    for k, text in enumerate(corpus):
        own = hashes[at[k]:at[k + 1]].tolist()
        assert len(own) == len(word_list(text))
        for w, h in zip(word_list(text), own, strict=True):
            assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w


def test_words_of_texts_over_a_tile(monkeypatch):
    import pyarrow as pa
    text = "ab " * 3000 + "q" * 9000 + " end"
    whole = textbytes.words(*textbytes.texts_of(pa.array([text])), 0, 1)
    monkeypatch.setattr(textbytes, "TILE", 1000)
    cut = textbytes.words(*textbytes.texts_of(pa.array([text])), 0, 1)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def shingle_set(text, width=5):
    w = word_list(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, corpus, percent):
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, corpus), percent).collect()}
    sets = [shingle_set(t) for t in corpus]
    root = list(range(len(corpus)))
    for i in range(len(corpus)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert len(rows) == len(corpus)
    for i in range(len(corpus)):
        assert (rows[i]["n_shingles"], rows[i]["component_id"], rows[i]["kept"]) == (len(sets[i]), root[i], root[i] == i)


def test_near_duplicates_in_blocks(spark, corpus, monkeypatch):
    want = {tuple(r) for r in minhash.near_duplicates(table(spark, corpus)).collect()}
    monkeypatch.setattr(minhash, "BLOCK_HASHES", 500)
    assert {tuple(r) for r in minhash.near_duplicates(table(spark, corpus)).collect()} == want


def test_a_task_of_near_duplicates_has_one_python_step(spark, corpus, monkeypatch):
    plans, keep = [], graph.stored

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    for module in (minhash, graph):
        monkeypatch.setattr(module, "stored", noted)
    plans.append(minhash.near_duplicates(table(spark, corpus))._jdf.queryExecution().executedPlan().toString())
    assert any("MapInPandas" in p and "MapInArrow" in p for p in plans)
    for plan in plans:  # two steps in one task are two workers, which hold memory long after
        held = 0
        for line in plan.splitlines():
            held = 0 if "Exchange" in line or "Join" in line else held + ("MapInArrow" in line or "MapInPandas" in line)
            assert held < 2, plan


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    sig = minhash.super_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15
    small = minhash.super_minhash(np.unique(pool[:3]), np.array([0, 3, 3]))
    assert np.isfinite(small[0]).all() and np.isinf(small[1]).all()
    assert sorted(np.floor(small[0]).tolist())[0] == 0


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 3), (2, None, 4), (3, "other words", 5)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got) == [
        (-1, None, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True)]
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 380)]
    root = {x: x for p in pairs for x in p}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    want = {(k, v) for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
    got = graph.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long").repartition(5), "a", "b")
    assert {tuple(r) for r in got.collect()} == want


def brute_repeats(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(r), sum(gone), runs, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def removed(spark, texts, window):
    rows = repeats.remove_repeats(table(spark, texts), window).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"])) for r in rows}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("window", [60, 200])
def test_repeats_equal_brute_force(spark, corpus, window):
    assert removed(spark, corpus, window) == brute_repeats(corpus, window)


def test_repeats_by_windows_and_in_tiles(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_KINDS", 2)
    assert removed(spark, corpus, 100) == brute_repeats(corpus, 100)


def test_repeats_of_odd_rows(spark):
    text = "p" * 150 + "q" * 150
    rows = [(None, text, 1, 7), (1, text, 2, 7), (1, text, 3, 7), (2, None, 4, 7)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans int, extra int"), 200)
    assert got.columns == ["doc_id", "extra", "kept", "n_bytes", "spans"]
    assert sorted((r["doc_id"] or 0, len(r["kept"]), r["n_bytes"]) for r in got.collect()) == [
        (0, 0, 300), (1, 0, 300), (1, 0, 300), (2, 0, 0)]
    assert repeats.remove_repeats(table(spark, []), 200).count() == 0


def test_cut_texts_drop_halves_of_characters(spark):
    same = "é" * 120
    docs = table(spark, ["a" + same + "ü" + "1", "b" + same + "û" + "2", None])
    rows = {r["doc_id"]: r for r in repeats.cut_texts(docs).collect()}
    assert rows[0]["text"] == "a1" and rows[1]["text"] == "b2" and rows[2]["text"] == "" and rows[0]["n_chars"] == 2
    assert repeats.cut_texts(docs).columns == docs.columns


def test_longest_matches_equal_brute_force():
    rng = random.Random(9)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(12)] + [b"a" * 30, b"a" * 31]
    text = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
    suffix = {p: strings[p[0]][p[1]:] for p in text}

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = [max(common(suffix[p], suffix[q]) for q in text if q != p) for p in text]
    assert repeats.longest_matches(strings).tolist() == want


def test_pieces_and_packing(spark, corpus):
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(tokens.default_tokenizer())
    texts = [*corpus, "İstanbul, ﬁne. क़ ΣΑΣ. Straße! it's. don't?! ...a.b, 12. x1, Ａb; <|endoftext|>. e\u0301t\u00e9.", "It's a <|endoftext|> day!\n\nNaïve  café—1234", "\x1cx y\xa0z", prose(random.Random(4), 3000)]
    capacity = 64
    rows = packing.pack(tokens.pieces(table(spark, texts), capacity), capacity, ("doc_id", "piece")).collect()
    want = {}
    for d, t in enumerate(texts):
        ids = tool.encode(t or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[at:at + capacity], "<u4").tobytes()
            want[d, p] = (at, len(own) // 4, zlib.crc32(own))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(filled) <= 1.02 * math.ceil(total / capacity) + 1


def pieces_here(texts, capacity=16, with_ids=None):
    """What a task makes of the texts: rows of (doc_id, piece, start, length, checksum[, ids])."""
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    made = tokens._piecer(tokens.default_tokenizer(), capacity, with_ids)(iter([batch]))
    return [tuple(r.values()) for b in made for r in b.to_pylist()]


def expected_pieces(texts, capacity=16):
    from tokenizers import Tokenizer
    tool, out = Tokenizer.from_file(tokens.default_tokenizer()), []
    for d, t in enumerate(texts):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            out.append((d, p, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), np.array(own, "<u2").tobytes()))
    return out


def odd_words(rng, n):
    """Chunks of letters of many kinds, marks, digits, white space and special tokens."""
    letters = [chr(k) for k in (*range(65, 91), *range(97, 123), *range(0xAA, 0x250), 0x3A3, 0x3C2, 0x430, 0x1E9E, 0x301, 0x4E2D, 0x1F600)]
    marks = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "'s", "'re", "\u2019t", "<|", "|>", "<|endoftext|>", "7", "\x0b", "\x1c", "\0", "\u2028"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(6))) + "".join(
        rng.choice(marks) for _ in range(rng.randrange(4))) + rng.choice(["", "", "", "s", "É"]) for _ in range(n)]


def test_ids_of_every_kind_of_chunk(monkeypatch):
    rng = random.Random(11)
    texts = [f"{chr(k)} x{chr(k)}. {chr(k)}{chr(k)}a***" for k in (*range(0x21, 0x250), 0x3A3, 0x1E9E, 0x212A, 0x212B, 0xFB01)]
    texts += ["".join(w + rng.choice(" \n\t\r\x0b\xa0") for w in odd_words(rng, 40)) for _ in range(150)]
    texts += [None, "", " ", "\n\n", "the " * 500]
    want = expected_pieces(texts)
    assert pieces_here(texts, with_ids="<u2") == want
    for name, few in (("MOST_KEPT", 50), ("BLOCK", 300), ("TILE", 7), ("BATCH_PIECES", 3)):  # every bound is met
        monkeypatch.setattr(tokens, name, few)
    assert pieces_here(texts, with_ids="<u2") == want
    assert pieces_here(texts) == [r[:-1] for r in want]


def test_tokenizer_gets_a_word_once(monkeypatch):
    from tokenizers import Tokenizer

    class Counted:
        given = 0

        def __init__(self, tool):
            self.tool = tool

        def encode_batch_fast(self, texts, **options):
            Counted.given += sum(map(len, texts))
            return self.tool.encode_batch_fast(texts, **options)

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeénßö") for _ in range(12)) for _ in range(500)]
    texts = [" ".join(rng.choice([w, w.capitalize()]) + rng.choice(["", ".", ",", "***", "%%%", ")", "\"."]) for w in words) for _ in range(80)]
    monkeypatch.setattr(tokens, "_encoders", {})
    tool = tokens.encoder(tokens.default_tokenizer())
    for name, held in list(vars(tool).items()):
        if isinstance(held, Tokenizer):
            setattr(tool, name, Counted(held))
    got = pieces_here(texts, 2048, "<u2")
    assert sum(map(len, words)) <= Counted.given <= 1.5 * sum(map(len, words))
    assert got == expected_pieces(texts, 2048)


def test_a_tokenizer_task_gives_back_what_arrow_holds(monkeypatch):
    seen = []

    class Pool:
        def release_unused(self):
            seen.append("released")

    tokens.encoder(tokens.default_tokenizer())
    monkeypatch.setattr(tokens.pa, "default_memory_pool", Pool)
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["a b", None])], ["doc_id", "text"])
    for _ in tokens._piecer(tokens.default_tokenizer(), 4, None)(iter([batch, batch])):
        seen.append("piece")
    assert seen == ["piece", "piece", "released"]


def test_words_of_another_tokenizer(tmp_path):
    import json
    made = json.loads(open(tokens.default_tokenizer()).read())
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] += "|x^"
    (tmp_path / "other.json").write_text(json.dumps(made))
    tool = tokens.WordEncoder(str(tmp_path / "other.json"))
    assert tool.latin is tool.tokenizer  # not known to keep words whole, so no shorter way
    assert tokens.WordEncoder(tokens.default_tokenizer()).latin is not tool.tokenizer


@pytest.mark.parametrize("seed", range(30))
def test_packing_plans(seed):
    rng = random.Random(seed)
    capacity = 12 if seed % 2 else 100
    low = 1 if seed % 3 else capacity // 3
    counts = dict(Counter(rng.randrange(low, capacity + 1) for _ in range(rng.randrange(1, 14 if seed % 2 else 400))))
    patterns = packing.plan(counts, capacity)
    used = Counter()
    for contents, times in patterns:
        assert times > 0 and 0 < sum(x * k for x, k in contents) <= capacity
        for x, k in contents:
            used[x] += k * times
    assert used == Counter(counts)
    if seed % 2:
        bins = sum(t for _, t in patterns)
        assert bins <= fewest([x for x, k in counts.items() for _ in range(k)], capacity) + 1
        left = packing._Left(counts, capacity)
        fixed = sum(t for _, t in packing.reduce(left, capacity))
        rest = [x for x in range(1, capacity + 1) for _ in range(int(left.n[x]))]
        assert fixed + fewest(rest, capacity) == fewest([x for x, k in counts.items() for _ in range(k)], capacity)


def fewest(sizes, capacity):
    """The least number of bins, by trying every subset (up to 13 pieces)."""
    n = len(sizes)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        for k in range(n):
            if mask >> k & 1:
                b, room = best[mask ^ (1 << k)]
                best[mask] = min(best[mask], (b, room + sizes[k]) if b and room + sizes[k] <= capacity else (b + 1, sizes[k]))
    return best[-1][0]


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scored(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "quality").collect()
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in rows)
    assert len(rows) > 40 and right / len(rows) > 0.9


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (None, None, 6), (1, "", 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1)], "doc_id long, quality int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_quadratic_discriminant_against_the_density():
    rng = np.random.default_rng(2)
    p = len(quality.FEATURES)
    mean = rng.normal(size=(2, p))
    cov = [np.eye(p) * (k + 1) + 0.2 for k in range(2)]
    model = quality.Model(np.log([0.3, 0.7]), mean, np.stack([np.linalg.inv(np.linalg.cholesky(c)) for c in cov]),
                          np.array([np.linalg.slogdet(c)[1] for c in cov]))
    x = rng.normal(size=(5, p))
    log = [np.log([0.3, 0.7][k]) - 0.5 * np.linalg.slogdet(cov[k])[1]
           - 0.5 * np.einsum("ij,jk,ik->i", x - mean[k], np.linalg.inv(cov[k]), x - mean[k]) for k in range(2)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_equals_a_walk(spark, corpus, order, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_BYTES", 4000)
    docs = table(spark, corpus)
    got = {r["doc_id"]: r for r in lm.scored(docs, F.col("doc_id") % 3 != 0, order, 5.0).collect()}
    grams = Counter()
    for d, t in enumerate(corpus):
        if d % 3:
            seq = ["<s>", *word_list(t), "</s>"]
            for i in range(1, len(seq)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        grams[tuple(seq[i - k + 1:i + 1])] += 1
    n = sum(c for g, c in grams.items() if len(g) == 1)
    v = sum(1 for g in grams if len(g) == 1)
    texts = sum(1 for d in range(len(corpus)) if d % 3)

    def times(h):
        return texts if h == ("<s>",) else grams[h]

    def chance(word, history):
        if not history:
            return (grams[(word,)] + 0.5) / (n + 0.5 * (v + 1))
        lower = chance(word, history[1:])
        return (grams[(*history, word)] + 5.0 * lower) / (times(history) + 5.0) if times(history) else lower

    for d, t in enumerate(corpus):
        seq = ["<s>", *word_list(t), "</s>"]
        walk = [(seq[i], tuple(seq[max(0, i - order + 1):i])) for i in range(1, len(seq))]
        r = got[d]
        assert (r["n_tokens"], r["train_tokens"]) == (len(walk), n)
        assert r["n_known"] == sum(1 for w, _ in walk if grams[(w,)])
        assert math.isclose(r["base_score"], sum(math.log10(chance(w, ())) for w, _ in walk), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(chance(w, h)) for w, h in walk), rel_tol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lanes_meet_in_the_states_of_one_walk(corpus, order, monkeypatch):
    tokens, bounds = lm._tokens(pa.chunked_array([pa.array([*corpus, "", " ".join(t or "" for t in corpus)], pa.string())]))
    keys, has = lm._grams(tokens, bounds, order)
    asked, where = lm._asked(keys, has)
    arcs = np.full((order, len(tokens)), -1)
    arcs[np.array(has)] = where
    learn = np.repeat(np.arange(len(bounds) - 1) % 3 != 0, np.diff(bounds))
    count = np.bincount(where, np.concatenate([learn[h] for h in has]), len(asked))
    model = lm.Automaton(arcs, bounds, count, int(learn.sum()), len(set(tokens[learn].tolist())), 5.0)
    told = []
    for lane in (10**9, 256, 7, 1):
        monkeypatch.setattr(lm, "LANE", lane)
        told.append(model.walk())
    assert all((t == told[0]).all() for t in told)
    learnt = model.count > 0
    states = np.flatnonzero(learnt[:-2] & (model.depth[:-2] < order))
    assert (model.target(states) == states).all() and (model.depth[model.fail[states]] == model.depth[states] - 1).all()
    assert learnt[model.fail[states][model.depth[states] > 1]].all()


def test_language_model_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    rows = lm.scored(docs, F.lit(None).cast("boolean")).collect()
    assert len(rows) == 3 and {r["train_tokens"] for r in rows} == {0} and {r["n_known"] for r in rows} == {0}
    assert lm.scored(docs.limit(0), F.lit(True)).count() == 0


def test_sorted_keys_round_trip():
    for keys in ([], [5], [0, 1, 2**64 - 1], sorted(random.Random(1).randrange(2**64) for _ in range(99))):
        x = np.array(keys, np.uint64)
        assert (lm.unpack_sorted(lm.pack_sorted(x)) == x).all()


def test_digest_of_the_repeat_query_is_of_the_bytes():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c44298fc1c149")
