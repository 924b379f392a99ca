"""Chunk boundaries and chunk texts of one unit, as array columns.

Reading a window deep inside a UTF-8 string walks the string from its start, so cutting a
long text window by window is quadratic. The text is therefore split once into pieces
longer than any chunk; every later read touches two neighbouring pieces at most.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

NO_BOUNDARY = r"^[^\n;})]*"
# A cut is sought in the last fifth of a chunk.
KEEP_NUM, KEEP_DEN = 4, 5
DEFAULT_SIZE = 4_000
DEFAULT_OVERLAP = 0.1
STREAM_SIZE = 1024 * 1024
# Fixed values of token-budget chunks.
MAX_TOKENS = 16_000
SOFT_SHARE = 0.25
CHARS_PER_TOKEN = 4
TOKEN_OVERLAP = 0.2


def fixed_cuts(code: Column, size: int) -> Column:
    """array<string> of consecutive cuts of exactly `size` characters, the last one shorter.

    An empty text is one empty cut, so that its unit is not lost."""
    return F.when(code == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(code, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def pieces(code: Column, size: int) -> Column:
    return F.when(F.length(code) <= size, F.array(code)).otherwise(fixed_cuts(code, size))


def _read(parts: Column, piece: int, start: Column, length: Column) -> Column:
    """`length` <= `piece` characters from the 0-based position `start`."""
    i = F.floor(start / F.lit(piece)).cast("int")
    both = F.concat(F.get(parts, i), F.coalesce(F.get(parts, i + 1), F.lit("")))
    return F.substring(both, start - i * piece + 1, length)


def _span(s: Column, e: Column) -> Column:
    return F.struct(s.alias("s"), e.alias("e"))


BLOCK = 128


def _fold(n: Column, steps: Column, end_of, overlap: int) -> Column:
    """Walk from cut to cut; stop once a chunk reaches the end of the text.

    Appending copies an array, so chunks are gathered in blocks of BLOCK, and the blocks are
    flattened once at the end.
    """

    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(a: Column, _: Column) -> Column:
        return F.when(a.done, a).otherwise(let(
            end_of(a.p),
            lambda end: let(F.concat(a.out, F.array(_span(a.p, end))), lambda out: F.struct(
                (end - overlap).alias("p"),
                (end >= n).alias("done"),
                F.when(F.size(out) < BLOCK, a.blocks).otherwise(
                    F.concat(a.blocks, F.array(out))).alias("blocks"),
                F.when(F.size(out) < BLOCK, out).otherwise(none).alias("out"),
            )),
        ))

    start = F.struct(
        F.lit(0).alias("p"), F.lit(False).alias("done"),
        F.array().cast("array<array<struct<s:int,e:int>>>").alias("blocks"), none.alias("out"),
    )
    return F.aggregate(F.sequence(F.lit(0), steps), start, step,
                       lambda a: F.flatten(F.concat(a.blocks, F.array(a.out))))


def _behind_last_boundary(window: Column, window_end: Column, otherwise: Column) -> Column:
    """Position behind the last boundary of a window that ends before `window_end`.

    Lengths count code points; match positions would count UTF-16 units."""
    def cut(w: Column) -> Column:
        rest = F.length(F.regexp_extract(F.reverse(w), NO_BOUNDARY, 0))
        return F.when(rest < F.length(w), window_end - rest).otherwise(otherwise)

    return let(window, cut)


def _cut(code: Column, piece: int, spans) -> Column:
    """array<struct<start, end, text>> for the spans that `spans(pieces, length)` gives."""
    bound = F.struct(pieces(code, piece).alias("parts"), F.length(code).alias("n"))
    return let(bound, lambda b: F.transform(
        spans(b.parts, b.n),
        lambda c: F.struct(
            c.s.cast("long").alias("start"), c.e.cast("long").alias("end"),
            _read(b.parts, piece, c.s, c.e - c.s).alias("text"),
        ),
    ))


def overlap_chunks(code: Column, size: int = DEFAULT_SIZE, overlap: int | None = None) -> Column:
    """Chunks of `size` characters cut behind the last boundary of the final fifth, where the
    next chunk starts `overlap` characters before the cut. One chunk when the text fits."""
    ov = int(size * DEFAULT_OVERLAP) if overlap is None else overlap
    keep = size * KEEP_NUM // KEEP_DEN
    if not 0 <= ov < keep:
        raise ValueError("overlap must be smaller than four fifths of the chunk size")
    piece = 2 * size

    def spans(parts: Column, n: Column) -> Column:
        def end_of(p: Column) -> Column:
            window = _read(parts, piece, p + (keep + 1), F.lit(size - keep))
            cut = _behind_last_boundary(window, p + (size + 1), p + size)
            return F.when(p + size >= n, n).otherwise(cut)

        return _fold(n, F.ceil(n / F.lit(float(min(size, keep + 2) - ov))).cast("int"), end_of, ov)

    return _cut(code, piece, spans)


def boundary_chunks(code: Column, size: int = STREAM_SIZE) -> Column:
    """Consecutive chunks: while `size` characters remain, cut behind the last boundary in
    the final fifth of them, else after all of them; what remains is the last chunk."""
    keep = -(-size * KEEP_NUM // KEEP_DEN)
    piece = 2 * size

    def spans(parts: Column, n: Column) -> Column:
        def end_of(p: Column) -> Column:
            window = _read(parts, piece, p + keep, F.lit(size - keep))
            cut = _behind_last_boundary(window, p + size, p + size)
            return F.when(p + size > n, n).otherwise(cut)

        fold = _fold(n, F.ceil(n / F.lit(float(keep + 1))).cast("int"), end_of, 0)
        return F.filter(fold, lambda c: (c.e > c.s) | (n == 0))

    return _cut(code, piece, spans)


def fixed_chunks(code: Column, size: int = STREAM_SIZE) -> Column:
    return F.transform(
        fixed_cuts(code, size),
        lambda text, i: F.struct(
            (i.cast("long") * size).alias("start"),
            (i.cast("long") * size + F.length(text)).alias("end"),
            text.alias("text"),
        ),
    )


def token_chunks(
    code: Column, max_tokens: int = MAX_TOKENS, soft: float = SOFT_SHARE,
    overlap: float = TOKEN_OVERLAP,
) -> Column:
    """Chunks of the soft token budget at four characters per token. The stride is constant,
    so each chunk is one stride of text plus the head of the next stride."""
    size = int(max_tokens * soft) * CHARS_PER_TOKEN
    stride = int(size * (1 - overlap) + 1e-9)
    head = size - stride
    if not 0 < head <= stride:
        raise ValueError("overlap must lie between 0 and one half")

    def chunks(b: Column) -> Column:
        return F.transform(b.strides, lambda text, i: F.struct(
            (i.cast("long") * stride).alias("start"),
            F.least(i.cast("long") * stride + size, b.n).alias("end"),
            F.concat(
                text, F.coalesce(F.left(F.get(b.strides, i + 1), F.lit(head)), F.lit(""))
            ).alias("text"),
        ))

    # a chunk that only repeats the tail of the one before it is not produced
    bound = F.struct(
        fixed_cuts(code, stride).alias("strides"), F.length(code).cast("long").alias("n"))
    return let(bound, lambda b: F.filter(
        chunks(b), lambda c: (c.start == 0) | (c.start + head < b.n)))
