"""Archives, matrices and segmentations: round trips, brute force and odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from codecorpus.llm import lattice, matrices, tokens, warc

PAGES = "page_id long, url string, html string"


def test_archive_round_trip(spark):
    rows = [(1, "http://a/x y", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "http://c", "<p>é</p>"),
            (5, "http://d\nGET", "WARC/1.0\r\n\r\n\r\n\r\nHTTP/1.1"), (7, "u", "<p>é</p>"), (8, "v", "HTTP/1.1 x\r\n\r\nbody"),
            (None, "w", "<p>é</p>"), (9, "z" * 3000, "long " * 50_000)]
    got = warc.archive(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    by = {r["key"]: r for r in got}
    for key, _, html in rows:
        raw = (html or "").encode()
        best = max(k for k, _, h in rows if k is not None and (h or "") == (html or ""))
        r = by[key]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        if key is not None:
            assert (r["record_type"], r["refers_to"]) == (("response", None) if key == best else ("revisit", best))
            assert r["payload"] is None if key != best else bytes(r["payload"]) == raw
    assert by[None]["record_type"] == "response" and by[1]["uri"] == "http://a/x%20y" and by[2]["uri"] == "-"
    assert by[1]["date"] == "2000-01-01T00:00:01Z"
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


def test_small_payloads_can_stay_responses(spark):
    rows = [(k, "u", h) for k, h in enumerate(["aa", "aa", "aaaa", "aaaa"])]
    got = {r["key"]: r["record_type"] for r in warc.archive(spark.createDataFrame(rows, PAGES), least=3).collect()}
    assert got == {0: "response", 1: "response", 2: "revisit", 3: "response"}


def test_repeated_pages(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (2, "v", "same")]
    got = warc.archive(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r["key"], r["record_type"], r["refers_to"]) for r in got) == [
        (1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None)]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files(version):
    records = [("http://a b/", "20240102030405", "text/html", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody\n\nmore"),
               ("dns:x", "1999", "text/dns", b""), ("http://c", "20240102030405", "image/x", bytes(range(256)))]
    raw = warc.arc_file(version, "x.arc", records)
    got = list(warc.parse_arc(raw))
    assert [(r.version, r.block, r.fields["Content-type"]) for r in got] == [(version, b, k) for _, _, k, b in records]
    assert got[0].fields["URL"] == "http://a%20b/" and warc.split_http(got[0].block)[1] == b"body\n\nmore"
    assert warc.split_http(got[2].block) == (b"", bytes(range(256)))
    assert warc.iso_date("1999") == "1999-01-01T00:00:00Z" and warc.iso_date("20240102030405") == "2024-01-02T03:04:05Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(raw[:-20]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(raw.replace(b"\n%d 0 " % version, b"\n7 0 ", 1)))


def test_several_records_in_an_arc_file(spark):
    raw = warc.arc_file(2, "x.arc", [("u", "2001", "text/plain", b"one"), ("u", "2001", "text/plain", b"two")])
    rows = warc.convert(spark.createDataFrame([(5, bytearray(raw))], "key long, arc binary")).collect()
    assert [bytes(r["payload"]) for r in rows] == [b"one", b"two"] and len({r["record_id"] for r in rows}) == 2


def test_records_of_any_bytes_and_types(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nX-Name: caf\xe9\r\n\r\n<p>\xe9</p>"
    image = bytes(range(256)) * 9
    records = [("http://a", "2001", "text/html", page), ("http://b/x", "2002", "image/png", image),
               ("dns:a", "2003", "text/dns", b"a. 1 IN A 1.2.3.4"), ("http://c", "2004", "no-type", b""),
               ("filedesc://y.arc", "2005", "text/plain", b"about")]
    arcs = spark.createDataFrame([(k, bytearray(warc.arc_file(1 + k, "x.arc", records))) for k in range(2)], "key long, arc binary")
    folder = str(tmp_path / "warc")
    warc.write_warc(warc.convert(arcs), warc.first_of_equal(warc.convert(arcs, with_payload=False)), folder, value_bytes=1000)
    got = {(r["key"], r["uri"]): r for r in warc.read_warc(spark, folder).collect()}
    assert len(got) == 10
    for uri, _, kind, block in records:
        about, payload = uri.startswith("filedesc:"), warc.split_http(block)[1]
        old, new = (got[k, None if about else uri] for k in range(2))
        assert new["record_type"] == ("warcinfo" if about else "resource" if kind != "text/html" else "response")
        assert bytes(new["payload"]) == payload and old["payload_bytes"] == len(payload)
        assert about or (old["record_type"], old["refers_to_id"]) == ("revisit", new["record_id"])
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("*.gz"))
    kinds = {(h["warc-type"], h["content-type"]) for h, _ in warc.parse_warc(raw) if h["warc-type"] != "revisit"}
    assert kinds == {("response", "application/http; msgtype=response"), ("resource", "image/png"), ("resource", "text/dns"),
                     ("resource", "application/octet-stream"), ("warcinfo", "text/plain")}
    assert page in raw and image in raw


def test_files_are_bounded(spark, tmp_path):
    arcs = spark.createDataFrame([(k, bytearray(warc.arc_file(1, "x", [("u", "2001", "a/b", b"%d" % k * 400)])))
                                  for k in range(100)], "key long, arc binary").coalesce(1)
    rows = warc.convert(arcs)
    warc.write_warc(rows, warc.first_of_equal(rows), str(tmp_path / "w"), value_bytes=1500)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("*.gz")]
    assert max(sizes) <= warc.VALUES * 1504 and warc.read_warc(spark, str(tmp_path / "w")).count() == 100


def test_archives_of_many_gzip_members(spark, tmp_path):
    parts = []
    for k in range(3):
        block = b"HTTP/1.1 200 OK\r\n\r\n%d" % k
        parts.append(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nWARC-Target-URI: u\r\n"
                                   b"WARC-Date: 2001-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n" % (k, len(block))
                                   + block + b"\r\n\r\n"))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    assert sorted(bytes(r["payload"]) for r in warc.read_warc(spark, str(tmp_path)).collect()) == [b"0", b"1", b"2"]


def test_warc_that_is_cut_short():
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100])
    lengths = np.array([rng.randrange(1, capacity + 1) for _ in range(120)])
    want: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [b for b in want if sum(lengths[b]) + lengths[k] <= capacity]
        if fits:
            max(fits, key=lambda b: sum(lengths[b])).append(k)
        else:
            want.append([k])
    got = matrices.best_fit_decreasing(lengths, capacity)
    assert sorted(k for g in got for k in g) == list(range(len(lengths)))
    assert all(sum(lengths[g]) <= capacity for g in got) and len(got) == len(want)
    assert sorted(sum(lengths[g]) for g in got) == sorted(sum(lengths[g]) for g in want)


def test_matrices_give_documents_back(spark):
    from tokenizers import Tokenizer
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 90))) for _ in range(40)] + [None, "", "x y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x")], "doc_id long, text string")
    rows = matrices.written(docs, capacity=32).collect()
    tool, got = Tokenizer.from_file(tokens.default_tokenizer()), {}
    for r in rows:
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 32 and len(r["input_ids"]) == 64
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        assert not any(np.frombuffer(r["input_ids"], "<u2")[r["n_tokens"]:])
        parts = matrices.unpack_row(r["input_ids"], r["cu_seqlens"])
        for d, p, s, ids in zip(r["doc_ids"], r["pieces"], r["starts"], parts, strict=True):
            assert s == 32 * p
            got[d, p] = ids.tolist()
    for i, t in [*enumerate(texts), (None, "x")]:
        ids = tool.encode(t or "", add_special_tokens=False).ids + [0]
        assert [x for p in range(-(-len(ids) // 32)) for x in got.pop((i, p))] == ids
    assert not got and matrices.packed(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tool():
    return lattice.lattice(lattice.default_model())


def every_path(tool, chunk):
    edges = tool.edges(chunk)

    def to(j):
        return [(0.0, ())] if not j else [(a + s, ids + own) for i, s, own in edges[j] for a, ids in to(i)]
    return sorted(to(len(chunk)), key=lambda x: -x[0])


@pytest.mark.parametrize("chunk", ["▁hello", "▁tion", "▁▁a", "x", "▁é日ß", "▁\U0001F9FFb", "▁aa.\naa"])
def test_best_paths_of_a_chunk(tool, chunk):
    want, got = every_path(tool, chunk), tool.paths(chunk, 6)
    assert np.allclose([s for s, _ in got], [s for s, _ in want[:6]])
    assert len({ids for _, ids in got}) == len(got) and got[0][1] in [p for s, p in want if abs(s - want[0][0]) < 1e-9]
    ids = dict((p, s) for s, p in want)
    assert all(abs(ids[p] - s) < 1e-9 for s, p in got)


@pytest.mark.parametrize("chunk", ["aaaaaaaa", "▁--------", "========", "▁ababab"])
@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_best_paths_with_ties(tool, chunk, n):
    want, got = every_path(tool, chunk), tool.paths(chunk, n)
    assert np.allclose([s for s, _ in got], [s for s, _ in want[:n]]) and len({ids for _, ids in got}) == len(got)


@pytest.mark.parametrize("size", [1000, 100_000])
@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_long_runs_of_one_character(tool, size, n):
    got = tool.encode("x" * size, n)
    assert len(got) == n and len({ids for _, ids in got}) == n
    assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)
    assert all(tool.decode(ids) == "x" * size for _, ids in got)


@pytest.mark.parametrize("text", ["the tion of and", "a b", "aa aa aa", "", " x"])
@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_best_segmentations_of_a_text(tool, text, n):
    got = tool.encode(text, n)
    if not text:
        assert got == [(0.0, b"")]
        return
    chunks = lattice._CHUNK.findall("▁" + text.replace(" ", "▁"))
    sums = sorted((sum(s for s, _ in c) for c in itertools.product(*(every_path(tool, c) for c in chunks))), reverse=True)
    assert np.allclose([s for s, _ in got], sums[:n]) and len({ids for _, ids in got}) == len(got)
    assert all(tool.decode(ids) == text for _, ids in got)


def test_decoding_gives_texts_back(spark):
    texts = ["Hello  world\n", " lead", "日本語 é \U0001F600 \x00", "x" * 5000, "tab\there", "", None, "a" * 70 + " b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "q")], "doc_id long, text string")
    rows = lattice.segmented(docs, with_ids=True).collect()
    assert all(r["decoded"] for r in rows) and len(rows) == len(texts) + 1
    assert all(zlib.crc32(bytes(i)) == c for r in rows for i, c in zip(r["ids"], r["crcs"], strict=True))
    assert all(r["scores"] == sorted(r["scores"], reverse=True) for r in rows)
    ids = spark.createDataFrame([(r["doc_id"], bytearray(r["ids"][0])) for r in rows] + [(99, None)], "doc_id long, ids binary")
    back = {r["doc_id"]: r["text"] for r in lattice.decoded(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} | {None: "q", 99: None}
    assert lattice.segmented(docs.limit(0)).count() == 0
