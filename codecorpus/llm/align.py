"""Alignment of two tokenizers over the bytes of a text, by sparse incidence matrices.

A token's row of an incidence matrix has a one in the column of each byte it covers. The row
products A x B-transposed, taken Gustavson's way over compressed rows built here, count the
bytes two tokens share: overlap links. With a column for a token's last byte only, they give
the pairs that end together; the bytes where such pairs end cut the tokens into groups, and the
same product of token-by-group matrices links all that share a group.

Both tokenizers part a text before a run of blanks, so a text falls into chunks there: tokens,
groups and links lie within chunks, and a worker keeps what it found for recent ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: White space of any kind but the blank; a run of white space that starts with it is not cut.
_OTHER = "\t-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff"
_CHUNK = re.compile(f" +[^ ]*(?:(?<=[{_OTHER}]) +[^ ]*)*")
_CUT = re.compile(f"(?<=[^ {_OTHER}])(?= )")
#: Characters of a text whose chunks are held at a time.
TILE = 1 << 18
#: Chunks a worker keeps; those not asked for again since as many others go first.
MOST_KEPT = 150_000
#: Longest chunk that is kept.
KEPT_SIZE = 64


#: Chunks the tokenizer A is given in one string.
ROW = 400


@dataclass
class Csr:
    """A sparse matrix of small counts in compressed rows."""

    bounds: np.ndarray  # row i holds entries bounds[i] to bounds[i + 1]
    columns: np.ndarray
    values: np.ndarray
    width: int

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(bounds, self.rows()[order], self.values[order], len(self.bounds) - 1)


def ranges(start: np.ndarray, end: np.ndarray, width: int) -> Csr:
    """Row i has ones in the columns start[i] to end[i], without the last."""
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    columns = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)
    return Csr(bounds, columns, np.ones(len(columns), np.int64), width)


def product(a: Csr, b: Csr) -> Csr:
    """Row i of the product: the rows of b that row i of a names, weighed and added up."""
    size = np.diff(b.bounds)[a.columns]
    bounds = np.concatenate([[0], np.cumsum(size)])
    entry = np.arange(bounds[-1]) + np.repeat(b.bounds[a.columns] - bounds[:-1], size)
    keys = np.repeat(a.rows(), size) * b.width + b.columns[entry]
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], (np.repeat(a.values, size) * b.values[entry])[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    row, column = np.divmod(keys[first], max(b.width, 1))
    total = np.add.reduceat(values, first) if len(first) else values
    n = len(a.bounds) - 1
    return Csr(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), column, total, b.width)


@dataclass
class Tokens:
    """Both tokenizers' tokens of some chunks in a row: ids, ends in bytes, tokens before each chunk."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_before: np.ndarray
    b_before: np.ndarray

    def _width(self) -> int:
        return int(self.a_end[-1]) if len(self.a_end) else 0

    def overlaps(self) -> Csr:
        """Shared bytes of each pair of tokens."""
        w = self._width()
        a = ranges(np.concatenate([[0], self.a_end[:-1]]), self.a_end, w)
        return product(a, ranges(np.concatenate([[0], self.b_end[:-1]]), self.b_end, w).transposed())

    def ends(self) -> Csr:
        """Pairs whose bytes end together."""
        w = self._width()
        return product(ranges(self.a_end - 1, self.a_end, w), ranges(self.b_end - 1, self.b_end, w).transposed())

    def groups(self, ends: Csr) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of A and of B: the pairs that end together cut them."""
        cuts = self.a_end[ends.rows()]
        return np.searchsorted(cuts, self.a_end), np.searchsorted(cuts, self.b_end)

    def in_group(self, of_a: np.ndarray, of_b: np.ndarray) -> Csr:
        """Pairs that share a group."""
        n = int(of_a[-1]) + 1 if len(of_a) else 0
        return product(ranges(of_a, of_a + 1, n), ranges(of_b, of_b + 1, n).transposed())


def byte_of() -> dict[str, int]:
    """Byte-level entries write a printable byte as the character of its number, the others, in order, as those from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """A byte-level tokenizer (A) and a piece model (B), what their ids stand for, and the id pairs
    that can end together."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        table, special = byte_of(), {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            if i not in special:
                self.a_bytes[i] = bytes(table[c] for c in entry)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece has a mark after another character: texts can't be cut at blanks")
            self.b_bytes.append(b"" if self.b.is_control(i) or self.b.is_unknown(i) else bytes([int(piece[1:-1], 16)])
                                if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self._pairs()
        self.a_bytes, self.b_bytes = (np.array([*x, None], object)[:-1] for x in (self.a_bytes, self.b_bytes))
        ids = [*range(len(self.a_bytes)), *range(len(self.b_bytes))]
        marks = ["|"] * len(self.a_bytes) + [";"] * len(self.b_bytes)
        #: Each id as it stands within a group and as the last of its side.
        self.written = np.array([f"{i}{m}" for i, last in zip(ids, marks, strict=True) for m in (",", last)], object)
        self.written_size = np.array([len(x) for x in self.written])
        self.white = {chr(c) for c in range(0x10000) if re.match(f"[ {_OTHER}]", chr(c))}
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _pairs(self) -> None:
        """Of two tokens that end together one is the end of the other, which bounds the pairs by the
        lengths of the entries whatever the corpus."""
        sides = (self.a_bytes, self.b_bytes)
        by: list[dict[bytes, list[int]]] = [{}, {}]
        for side, entries in enumerate(sides):
            for i, x in enumerate(entries):
                if x:
                    by[side].setdefault(x, []).append(i)
        pairs = {(i, j) for i, x in enumerate(self.a_bytes) for k in range(len(x)) for j in by[1].get(x[k:], ())}
        pairs |= {(i, j) for j, x in enumerate(self.b_bytes) for k in range(len(x)) for i in by[0].get(x[k:], ())}
        self.keys = np.sort(np.fromiter((i * len(self.b_bytes) + j for i, j in pairs), np.int64, len(pairs)))
        self.pair_b = self.keys % max(len(self.b_bytes), 1)
        self.pair_a = self.keys // max(len(self.b_bytes), 1)

    def encode(self, chunks: Sequence[str]) -> tuple[Tokens, list[bool]]:
        """Tokens of the chunks that both tokenizers give back byte for byte, and which these are."""
        raw = [c.encode() for c in chunks]
        a, a_before, good_a = self._kept(self._encode_a(chunks, raw), self.a_bytes, self.a_size, raw)
        # the piece model puts a mark before a text, and drops a text that is only this mark
        found = self.b.encode([c[1:] for c in chunks], num_threads=1)
        for k, ids in enumerate(found):
            if not ids:
                found[k] = self.b.encode("x" + chunks[k])[len(self.b.encode("x")):]
        b, b_before, good_b = self._kept(self._flat(found), self.b_bytes, self.b_size, raw)
        same = good_a & good_b
        if not same.all():
            a, a_before, b, b_before = *_chosen(a, a_before, same), *_chosen(b, b_before, same)
        return Tokens(a, b, np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), a_before, b_before), same.tolist()

    @staticmethod
    def _flat(ids: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many stand before each chunk."""
        before = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), out=before[1:])
        return np.fromiter(chain.from_iterable(ids), np.int64, int(before[-1])), before

    def _encode_a(self, chunks: Sequence[str], raw: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A. Chunks go to the tokenizer some hundreds in a row, and up to one that ends in
        white space: what follows would change its tokens."""
        rows: list[list[str]] = [[]]
        for c in chunks:
            rows[-1].append(c)
            if c[-1] in self.white or len(rows[-1]) >= ROW:
                rows.append([])
        found = self.a.encode_batch_fast(["".join(r) for r in rows], add_special_tokens=False)
        ids = self._flat([e.ids for e in found])[0]
        ends = np.cumsum(self.a_size[ids])
        bounds = np.cumsum([0, *map(len, raw)])
        before = np.searchsorted(ends, bounds, "right")
        if np.array_equal(np.concatenate([[0], ends])[before], bounds):
            return ids, before
        return self._flat([e.ids for e in self.a.encode_batch_fast(list(chunks), add_special_tokens=False)])

    @staticmethod
    def _kept(found: tuple[np.ndarray, np.ndarray], entries: np.ndarray, sizes: np.ndarray,
              raw: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """found, and per chunk whether its tokens' bytes are its own."""
        ids, before = found
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[before]
        own = np.fromiter(map(len, raw), np.int64, len(raw))
        same = np.diff(ends) == own
        got = b"".join(entries[ids].tolist())
        if not same.all() or got != b"".join(raw):
            e = ends.tolist()
            same = np.array([got[e[k]:e[k + 1]] == x for k, x in enumerate(raw)], bool)
        return ids, before, same

    def _align(self, chunks: Sequence[str]) -> None:
        """Learns (tokens of A, tokens of B, groups, links as numbers of pairs, groups as text, a
        semicolon behind each) of new chunks."""
        tokens, same = self.encode(chunks)
        ends = tokens.ends()
        cut_a, cut_b = ends.rows(), ends.columns  # the last token of A and of B of each group
        keys = tokens.a[cut_a] * len(self.b_bytes) + tokens.b[cut_b]
        codes = np.searchsorted(self.keys, keys).astype("<u4")
        if len(keys) and not np.array_equal(self.keys[np.minimum(codes, len(self.keys) - 1)], keys):
            raise RuntimeError("a pair that ends together is not among the possible ones")
        # entries of `written` in the order of the text: tokens of A of a group, then those of B
        group_a, group_b = tokens.groups(ends)
        last_a, last_b = np.zeros(len(tokens.a), np.int64), np.zeros(len(tokens.b), np.int64)
        last_a[cut_a] = last_b[cut_b] = 1
        entry = np.concatenate([2 * tokens.a + last_a, 2 * (len(self.a_bytes) + tokens.b) + last_b])
        entry = entry[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")]
        text = "".join(self.written[entry].tolist())
        reach = np.concatenate([[0], np.cumsum(self.written_size[entry])])
        before = tokens.a_before + tokens.b_before
        at = reach[before].tolist()
        # a chunk's last tokens end together, so the groups before it are those its first token comes behind
        opening = np.searchsorted(cut_a, tokens.a_before)
        links, first = codes.tobytes(), (4 * opening).tolist()
        facts = zip(np.diff(tokens.a_before).tolist(), np.diff(tokens.b_before).tolist(), np.diff(opening).tolist(),
                    [links[i:j] for i, j in pairwise(first)], [text[i:j] for i, j in pairwise(at)], strict=True)
        self.known.update(zip(compress(chunks, same), facts, strict=True))
        self.known.update((c, None) for c, s in zip(chunks, same, strict=True) if not s)

    def learn(self, chunks: set[str]) -> list[str]:
        """Aligns the chunks that are not known; returns those too long to be kept."""
        if len(self.known) > MOST_KEPT:
            self.known, self.older = {}, self.known
        new = chunks - self.known.keys()
        again = new & self.older.keys()
        self.known.update({c: self.older[c] for c in again})
        new -= again
        if new:
            self._align(list(new))
        return [c for c in new if len(c) > KEPT_SIZE]


def _chosen(ids: np.ndarray, before: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some of the chunks."""
    sizes = np.diff(before)
    return ids[np.repeat(same, sizes)], np.concatenate([[0], np.cumsum(sizes[same])])


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One pair of tokenizers per process."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tiles(text: str) -> Iterator[list[str]]:
    """The chunks of a blank and a text, those of about TILE characters at a time."""
    text, at = " " + text, 0
    while at < len(text):
        cut = _CUT.search(text, at + TILE) if at + TILE < len(text) else None
        end = cut.start() if cut else len(text)
        yield _CHUNK.findall(text, at, end)
        at = end


_NONE = (0, 0, 0, b"", "")


def _documents(tool: Pair, texts: Sequence[str]) -> list[tuple]:
    """Per text: tokens of A and B, groups, links, groups as text with a semicolon behind each.

    New chunks of about TILE characters of texts are aligned together; more are not held."""
    out: list[tuple] = []
    waiting: list[list[str]] = []
    size = 0

    def settle() -> None:
        nonlocal size
        long = tool.learn(set().union(*waiting))
        get = tool.known.__getitem__
        for w in waiting:
            facts = list(map(get, w))
            if None in facts:
                out.append(_NONE)
                continue
            a, b, g, links, groups = zip(*facts, strict=True) if facts else ((),) * 5
            out.append((sum(a), sum(b), sum(g), b"".join(links), "".join(groups)))
        for c in long:
            del tool.known[c]
        waiting.clear()
        size = 0

    for text in texts:
        if len(text) <= TILE:
            waiting.append(_CHUNK.findall(" " + text) if text else [])
            size += len(text)
            if size > TILE:
                settle()
            continue
        settle()
        parts = []
        for chunks in tiles(text):
            waiting.append(chunks)
            settle()
            parts.append(out.pop())
            if parts[-1] is _NONE:
                break
        if parts[-1] is _NONE:
            out.append(_NONE)
        else:
            a, b, g, links, groups = zip(*parts, strict=True)
            out.append((sum(a), sum(b), sum(g), b"".join(links), "".join(groups)))
    settle()
    return out


def _aligner(paths: tuple[str, str]) -> Callable:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pair(*paths)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                a, b, g, links, groups = zip(*_documents(tool, texts), strict=True)
                yield pa.record_batch(
                    [part.column("key"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(g, pa.int64()),
                     pa.array([len(x) // 4 for x in links], pa.int64()), pa.array([x[:-1] for x in groups], pa.string()),
                     pa.array(links, pa.binary())],
                    ["key", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])
    return align


def _rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows, rows.schema["key"].dataType.simpleString()


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """Per row of docs: key, n_a, n_b, n_groups, n_links, groups and links.

    A encodes a blank and the text, B the text, both without special tokens. groups is
    "a1,a2|b1;a3|b2,b3", the ids of each group in order; links are the pairs of tokens that end
    together, in order, as the little-endian unsigned 32-bit numbers that `id_pairs` explains. Null
    and empty texts, and those whose tokens do not give the text back (one with a piece mark of its
    own), have no tokens: zeros, empty groups and links. Null keys and rows that repeat give rows of
    their own; other columns are not read.
    """
    rows, kind = _rows(docs, key, text)
    return rows.mapInArrow(
        _aligner(tokenizers or default_tokenizers()),
        f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary").withColumnRenamed("key", key)


def id_pairs(tokenizers: tuple[str, str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of A and of B of each numbered pair. They follow from the two vocabularies alone."""
    tool = pair(*(tokenizers or default_tokenizers()))
    return tool.pair_a, tool.pair_b


def pair_counts(rows: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """(pair, count) over all links of rows of `aligned`. A task adds up all its rows first; there
    are at most as many pairs as `id_pairs` has."""
    n = len(id_pairs(tokenizers)[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            codes, _ = _codes(batch.column("links"))
            total += np.bincount(codes, minlength=n)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some])], ["pair", "count"])

    return rows.select("links").mapInArrow(count, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All links of a column and the bounds of its rows; nulls have none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    raw = np.frombuffer(memoryview(data)[bounds[0]:bounds[-1]], "<u4")
    return raw, (bounds - bounds[0]) // 4


def with_counts(rows: DataFrame, counts: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """rows of `aligned` with n_best, the links whose pair has the highest count of its B id, ties
    included, and count_sum, the sum of the links' counts.

    counts goes to every task as one array. Its size is that of `id_pairs` (324 297 for the default
    tokenizers, 8 bytes each), however large the corpus is.
    """
    _, pair_b = id_pairs(tokenizers)
    found = counts.toArrow()
    total = np.zeros(len(pair_b), np.int64)
    total[found.column("pair").to_numpy()] = found.column("count").to_numpy()
    most = np.zeros(int(pair_b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, pair_b, total)
    best = (total == most[pair_b]) & (total > 0)
    names = [c for c in rows.columns if c != "links"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bounds = _codes(batch.column("links"))
            sums = [np.concatenate([[0], np.cumsum(x[codes], dtype=np.int64)]) for x in (best, total)]
            yield pa.record_batch(
                [*(batch.column(c) for c in names), *(pa.array(np.diff(s[bounds])) for s in sums)], [*names, "n_best", "count_sum"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "links")
    return rows.mapInArrow(score, f"{kinds}, n_best long, count_sum long")


def links(docs: DataFrame, kind: str = "overlap", key: str = "doc_id", text: str = "text",
          tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """A row per link of two tokens of a text: key, a and b (their places), a_id, b_id, weight.

    kind "overlap": tokens that share bytes, weight their number; "group": tokens of one group;
    "end": tokens that end together, both with weight 1. Texts without tokens (see `aligned`) have none.
    """
    if kind not in ("overlap", "group", "end"):
        raise ValueError(kind)
    paths = tokenizers or default_tokenizers()
    rows, of = _rows(docs, key, text)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pair(*paths)
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column("text")[i].as_py() or ""
                if body and all(all(tool.encode(chunks)[1]) for chunks in tiles(body)):
                    at_a = at_b = 0
                    for chunks in tiles(body):
                        tokens = tool.encode(chunks)[0]
                        found = tokens.overlaps() if kind == "overlap" else tokens.ends()
                        if kind == "group":
                            found = tokens.in_group(*tokens.groups(found))
                        a, b = found.rows(), found.columns
                        yield pa.record_batch(
                            [batch.column("key").take(pa.array(np.full(len(a), i))), pa.array(a + at_a), pa.array(b + at_b),
                             pa.array(tokens.a[a]), pa.array(tokens.b[b]), pa.array(found.values)],
                            ["key", "a", "b", "a_id", "b_id", "weight"])
                        at_a, at_b = at_a + len(tokens.a), at_b + len(tokens.b)

    return rows.mapInArrow(link, f"key {of}, a long, b long, a_id long, b_id long, weight long").withColumnRenamed("key", key)
