"""Cross-tokenizer alignment against a plain version over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from codecorpus.llm import align, queries

WHITE = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u3000", "\ufeff"]
PARTS = [*WHITE, " ", " ", " ", "the", " of", "and", "don't", "'s", "abc", "é", "日本", "\U0001F600", "\x00", "12", "!?", "...",
         "<|endoftext|>", "<s>", "<0x41>", "X", "ing", "\n\n", "x" * 9]


@pytest.fixture(scope="module")
def tool():
    return align.pair(*align.default_tokenizers())


def whole(tool, text):
    """Ids, ends and groups of a text encoded in one piece; None without tokens."""
    if not text:
        return None
    a = tool.a.encode(" " + text, add_special_tokens=False).ids
    b = tool.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(tool.a_bytes[i] for i in a) != raw or b"".join(tool.b_bytes[i] for i in b) != raw:
        return None
    ends_a, ends_b = (np.cumsum([len(table[i]) for i in ids]).tolist() for ids, table in ((a, tool.a_bytes), (b, tool.b_bytes)))
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = [], []
        while i < len(a) and ends_a[i] <= cut:
            x.append(a[i])
            i += 1
        while j < len(b) and ends_b[j] <= cut:
            y.append(b[j])
            j += 1
        groups.append((x, y))
    return a, b, ends_a, ends_b, groups


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(0, 25))) for _ in range(n)]


def expected(tool, rows):
    out, counts = [], Counter()
    for _, t in rows:
        found = whole(tool, t)
        if found:
            a, b, ends_a, ends_b, _ = found
            at = {e: i for i, e in zip(b, ends_b, strict=True)}
            counts.update((i, at[e]) for i, e in zip(a, ends_a, strict=True) if e in at)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    for d, t in rows:
        found = whole(tool, t)
        if not found:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, ends_a, ends_b, groups = found
        at = {e: i for i, e in zip(b, ends_b, strict=True)}
        own = [(i, at[e]) for i, e in zip(a, ends_a, strict=True) if e in at]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(own), sum(counts[p] == most[p[1]] for p in own),
                    sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest()))
    return out


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_as_over_whole_texts(spark, tool, tmp_path, monkeypatch):
    texts = [None, "", " ", "  ", "a", " a", "a ", "▁", "a ▁b", "x" * 30_000, "word " * 90_000, "é\n" * 50_000, "\n " * 500] + random_texts(1, 3000)
    rows = [*enumerate(texts), (None, "the end"), (7, "twice"), (7, "twice")]
    spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, links int, groups string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = queries.op11_byte_incidence(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in NAMES) for r in got), key=repr) == sorted(expected(tool, rows), key=repr)


def test_query_on_the_given_texts(spark, tool):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op11_byte_incidence(spark, sf).collect()
    assert sorted(tuple(r[c] for c in NAMES) for r in got) == sorted(expected(tool, rows))


@pytest.mark.parametrize("seed", range(4))
def test_chunks_as_whole_texts(tool, seed, monkeypatch):
    monkeypatch.setattr(align, "TILE", 40)
    texts = random_texts(10 + seed, 1500)
    for text, (n_a, n_b, n_groups, raw, groups) in zip(texts, align._documents(tool, texts), strict=True):
        found = whole(tool, text)
        if not found:
            assert (n_a, n_b, n_groups, raw, groups) == align._NONE
            continue
        a, b, _, _, want = found
        assert groups == "".join(f"{','.join(map(str, x))}|{','.join(map(str, y))};" for x, y in want)
        assert (n_a, n_b, n_groups) == (len(a), len(b), len(want))
        codes = np.frombuffer(raw, "<u4")
        assert [(int(tool.pair_a[c]), int(tool.pair_b[c])) for c in codes] == [(x[-1], y[-1]) for x, y in want]


def test_evicted_chunks_come_back(tool, monkeypatch):
    monkeypatch.setattr(align, "MOST_KEPT", 3)
    texts = ["one two three four five", "six one seven eight", "one two nine"] * 3
    first = align._documents(tool, texts)
    assert first == [align._documents(tool, [t])[0] for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_products(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, (5, 7)), rng.integers(0, 3, (4, 7))

    def sparse(m):
        rows, columns = np.nonzero(m)
        return align.Csr(np.concatenate([[0], np.cumsum(np.count_nonzero(m, axis=1))]), columns, m[rows, columns], m.shape[1])
    got = align.product(sparse(a), sparse(b).transposed())
    full = np.zeros((5, 4), int)
    full[got.rows(), got.columns] = got.values
    assert (full == a @ b.T).all() and (np.diff(got.bounds) == np.count_nonzero(a @ b.T, axis=1)).all()


@pytest.mark.parametrize("kind", ["overlap", "group", "end"])
def test_links_of_tokens(spark, tool, kind, monkeypatch):
    texts = ["Hello wonderful world, 日本語!", "", None, "▁", *random_texts(3, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in align.links(docs, kind).collect():
        got.setdefault(r["doc_id"], {})[r["a"], r["b"]] = (r["a_id"], r["b_id"], r["weight"])
    for d, t in enumerate(texts):
        found = whole(tool, t)
        if not found:
            assert d not in got
            continue
        a, b, ends_a, ends_b, groups = found
        start_a, start_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
        cuts = sorted(set(ends_a) & set(ends_b))
        want = {}
        for i in range(len(a)):
            for j in range(len(b)):
                shared = min(ends_a[i], ends_b[j]) - max(start_a[i], start_b[j])
                weight = {"overlap": max(shared, 0), "end": int(ends_a[i] == ends_b[j]),
                          "group": int(np.searchsorted(cuts, ends_a[i]) == np.searchsorted(cuts, ends_b[j]))}[kind]
                if weight:
                    want[i, j] = (a[i], b[j], weight)
        assert got[d] == want
    assert align.links(docs.limit(0), kind).count() == 0
    with pytest.raises(ValueError):
        align.links(docs, "other")


def test_empty_table(spark):
    rows = align.aligned(spark.createDataFrame([], "doc_id long, text string"))
    assert align.with_counts(rows, align.pair_counts(rows)).count() == 0
