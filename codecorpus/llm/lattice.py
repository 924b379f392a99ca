"""N-best segmentation over a lattice of SentencePiece pieces, and decoding.

A text, blanks replaced by the piece mark and one mark put before it, is cut before each run of
marks; where no piece has a mark after another character, no piece spans a cut and the lattice
falls into these chunks. Within a chunk, forward Viterbi gives each position the best score of
reaching it, and an A-star search from the end takes these as exact estimates, so complete
paths come out best first. A text's best segmentation takes the best path of each chunk, which
Viterbi gives with the loss of the second best; only the n - 1 chunks of least loss can hold
another of the n best, and A-star lists the paths of these.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Chunks whose best path a worker keeps; those not asked for again since as many others go first.
MOST_KEPT = 300_000
#: Log score of a byte of a character that has no piece.
BYTE_SCORE = -16.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Pieces with log scores. Models that rank merges get Zipf's law over the rank: the score of
    rank r is -log((r + 2) * H), H making the chances add up to one."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw: list[bytes] = []  # what each id stands for
        self.byte: dict[int, int] = {}
        usable = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.encode())
                usable.append((piece, i))
        if any(MARK in p.lstrip(MARK) for p, _ in usable):
            raise ValueError("a piece has a mark after another character: texts can't be cut at marks")
        if len(self.byte) != 256:
            raise ValueError("the model has no bytes to fall back on")
        ranks = {i: r for r, i in enumerate(sorted(i for _, i in usable))}
        norm = math.log(sum(1 / (r + 2) for r in range(len(usable))))
        self.score = {p: (-math.log(ranks[i] + 2) - norm, i) for p, i in usable}
        #: Pieces, and None for what only starts one: a walk along a text ends where nothing goes on.
        self.walk: dict[str, tuple[float, int] | None] = {
            p[:k]: None for p in self.score for k in range(1, len(p))} | self.score
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def edges(self, chunk: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each position, the pieces that end there: start, score, ids."""
        out: list[list] = [[] for _ in range(len(chunk) + 1)]
        for i in range(len(chunk)):
            for j, score, ids in self.starting(chunk, i):
                out[j].append((i, score, ids))
        return out

    def starting(self, chunk: str, i: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """The pieces that start at a position: end, score, ids."""
        for j in range(i + 1, len(chunk) + 1):
            hit = self.walk.get(chunk[i:j], False)
            if hit:
                yield j, hit[0], (hit[1],)
            elif j == i + 1:
                raw = chunk[i].encode("utf-8", "surrogatepass")
                yield j, BYTE_SCORE * len(raw), tuple(self.byte[b] for b in raw)
            if hit is False:
                return

    def best(self, chunk: str) -> tuple[float, float, bytes]:
        """(loss of the second best path, score and ids of the best), by the two best at each position."""
        n, walk = len(chunk), self.walk
        first, second = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)
        came: list = [None] * (n + 1)
        for i in range(n):
            one, two = first[i], second[i]
            for j in range(i + 1, n + 1):
                hit = walk.get(chunk[i:j], False)
                if hit:
                    score, own = hit
                elif j == i + 1:
                    raw = chunk[i].encode("utf-8", "surrogatepass")
                    score, own = BYTE_SCORE * len(raw), raw
                elif hit is None:
                    continue
                else:
                    break
                value = one + score
                if value > first[j]:
                    second[j] = max(first[j], two + score)
                    first[j], came[j] = value, (i, own)
                elif value > second[j]:
                    second[j] = value
                if hit is False:
                    break
        ids: list[int] = []
        while n:
            n, own = came[n]
            if isinstance(own, bytes):
                ids += [self.byte[b] for b in reversed(own)]
            else:
                ids.append(own)
        return first[-1] - second[-1], first[-1], np.array(ids[::-1], "<u4").tobytes()

    def paths(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a chunk, best first; ties by earlier discovery.

        No position lies on more than n of the n best paths, so later entries of a position that
        was taken n times already go; runs of one character, whose orders tie, stay cheap.
        """
        edges = self.edges(chunk)
        best = [0.0] + [-math.inf] * len(chunk)
        for j in range(1, len(chunk) + 1):
            for i, s, _ in edges[j]:
                if best[i] + s > best[j]:
                    best[j] = best[i] + s
        # backward A-star: an entry is (- estimate of the whole, tie, position, score so far, ids behind)
        heap, tie, out = [(-best[-1], 0, len(chunk), 0.0, None)], 0, []
        taken = [0] * (len(chunk) + 1)
        while heap and len(out) < n:
            total, _, j, got, behind = heapq.heappop(heap)
            taken[j] += 1
            if taken[j] > n:
                continue
            if not j:
                ids: list[int] = []
                while behind:
                    ids += behind[0]
                    behind = behind[1]
                out.append((-total, tuple(ids)))
                continue
            for i, s, own in edges[j]:
                tie += 1
                heapq.heappush(heap, (-(got + s + best[i]), tie, i, got + s, (own, behind)))
        return out

    def chunk(self, chunk: str) -> tuple[float, float, bytes]:
        """`best`, kept for the next time."""
        found = self.known.get(chunk)
        if found is None:
            found = self.older.get(chunk) or self.best(chunk)
            if len(self.known) >= MOST_KEPT:
                self.known, self.older = {}, self.known
            if len(chunk) < 64:
                self.known[chunk] = found
        return found

    def encode(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text: score, ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return [(0.0, b"")]
        chunks = _CHUNK.findall(MARK + text.replace(" ", MARK))
        get = self.known.get
        facts = [get(c) or self.chunk(c) for c in chunks]
        parts = [f[2] for f in facts]
        score = math.fsum(f[1] for f in facts)
        singles = []  # the n - 1 least losses of changing one chunk; no others can be needed
        for loss, k in heapq.nsmallest(n - 1, zip((f[0] for f in facts), range(len(facts)), strict=True)):
            if loss < math.inf:
                top, *rest = self.paths(chunks[k], n)
                singles += [(top[0] - value, k, np.array(ids, "<u4").tobytes()) for value, ids in rest]
                parts[k] = np.array(top[1], "<u4").tobytes()  # of equally good paths, the one the rest differ from
        singles = sorted(singles, key=lambda x: x[:2])[:n - 1]
        out = [(score, b"".join(parts))]
        heap = [(singles[0][0], (0,))] if singles else []
        while heap and len(out) < n:
            loss, chosen = heapq.heappop(heap)
            if len({singles[c][1] for c in chosen}) == len(chosen):  # one change to a chunk at most
                changed = parts[:]
                for c in chosen:
                    changed[singles[c][1]] = singles[c][2]
                out.append((score - loss, b"".join(changed)))
            last = chosen[-1]
            if last + 1 < len(singles):
                step = singles[last + 1][0]
                heapq.heappush(heap, (loss + step, (*chosen, last + 1)))
                heapq.heappush(heap, (loss - singles[last][0] + step, (*chosen[:-1], last + 1)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, bytes put together, marks as blanks, without the first."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """One lattice per worker."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def _encoder(path: str, n: int, with_ids: bool) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = lattice(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = []
                for text in part.column(1).to_pylist():
                    found = tool.encode(text or "", n)
                    best = found[0][1]
                    rows.append((len(best) // 4, zlib.crc32(best), [s for s, _ in found],
                                 [zlib.crc32(ids) for _, ids in found],
                                 tool.decode(best) == (text or "").replace(MARK, " "),
                                 [ids for _, ids in found] if with_ids else []))
                size, crc, scores, crcs, same, ids = zip(*rows, strict=True)
                columns = [part.column(0), pa.array(size, pa.int64()), pa.array(crc, pa.int64()),
                           pa.array(scores, pa.list_(pa.float64())), pa.array(crcs, pa.list_(pa.int64())), pa.array(same)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.binary())))
                yield pa.record_batch(columns, ["doc_id", "n_ids", "ids_crc32", "scores", "crcs", "decoded", "ids"][:len(columns)])
    return encode


def segmented(docs: DataFrame, n: int = 3, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text), the n best segmentations: n_ids and ids_crc32 of the best, scores
    and crcs of all, best first, whether the best decodes to the text, and if wanted the ids.

    Characters without a piece are bytes. A piece mark in a text counts as a blank. Null and
    empty texts have no ids and one segmentation, of score 0. A text with fewer than n
    segmentations has as many as there are. ids are little-endian unsigned 32-bit. Repeated rows
    and null doc_ids are carried; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _encoder(model or default_model(), n, with_ids),
        f"doc_id {kind}, n_ids long, ids_crc32 long, scores array<double>, crcs array<long>, decoded boolean"
        + (", ids array<binary>" if with_ids else ""))


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """rows (doc_id, ids binary) with their text; null ids have a null text."""
    path = model or default_model()

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = lattice(path)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"),
                                "text": [None if x is None else tool.decode(x) for x in f["ids"]]})
    return rows.select(F.col("doc_id").cast("long"), "ids").mapInPandas(decode, "doc_id long, text string")
