"""Fill-in-middle: a text's units are cut in three and written in another order.

A unit is a word with the white space before it, or white space that ends the text. Texts lie in
a block as UTF-8, each from a multiple of eight bytes on, and the block is read as 64-bit words.
The bytes that end a unit are marked arithmetically, eight at a time; a population count per
word and its running sum give the units of a text and, by a binary search, the word in which a
wanted unit ends; byte-wise prefix counts inside the word give the byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.text import let

from .textbytes import SPACE, blocks, texts_of

U64 = np.uint64
_EACH = U64(0x0101010101010101)
_HIGH = U64(0x8080808080808080)
_LOW = U64(0x7F7F7F7F7F7F7F7F)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def every(byte: int) -> np.uint64:
    """A word of eight times the same byte."""
    return U64(byte) * _EACH


def spaces(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is 0x20 or 0x09 to 0x0D.

    Sums stay below 0x100 per byte, as their left side is below 0x80: nothing is carried over.
    """
    low = w & _LOW
    other = (low ^ every(0x20)) + _LOW  # high bit: not 0x20
    control = (low + every(0x80 - 0x09)) & ~(low + every(0x80 - 0x0E))
    return (~other | control) & ~w & _HIGH


def unit_ends(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is no white space and stands before white space, little-endian."""
    gap = spaces(w)
    following = np.append(gap[1:], _HIGH) << U64(56)
    return ~gap & ((gap >> U64(8)) | following) & _HIGH


def first_bytes(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte that begins a code point."""
    return ~(w & ~(w << U64(1))) & _HIGH


def running(marks: np.ndarray) -> np.ndarray:
    """Marks before each word, and at last all of them."""
    out = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(np.bitwise_count(marks), out=out[1:])
    return out


def select(marks: np.ndarray, sums: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of the marks of the given ranks, counted from 1."""
    word = np.searchsorted(sums[1:], rank)
    inside = (rank - sums[word]).astype(U64)
    upto = (marks[word] >> U64(7)) * _EACH  # per byte, the marks up to it
    short = ~((upto | _HIGH) - inside * _EACH) & _HIGH  # bytes with too few
    return 8 * word + np.bitwise_count(short)


def rank(marks: np.ndarray, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks before the given positions."""
    word, byte = np.divmod(at, 8)
    own = np.append(marks, U64(0))[word] & ((U64(1) << (8 * byte).astype(U64)) - U64(1))
    return sums[word] + np.bitwise_count(own)


def cuts(texts: Sequence[bytes], one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: its units n, the bytes before the middle and up to its end, the code points of both.

    The cuts lie after one % (n + 1) and two % (n + 1) units, in ascending order.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    wide = sizes // 8 + 1  # at least a blank behind each text
    words = np.concatenate([[0], np.cumsum(wide)])
    data = np.frombuffer(b"".join(t.ljust(8 * k, b" ") for t, k in zip(texts, wide.tolist(), strict=True)), "<u8")
    ends = unit_ends(data)
    start = 8 * words[:-1]
    last = (start + sizes - 1)[sizes > 0]
    raw = ends.view(np.uint8)
    raw[last[SPACE[data.view(np.uint8)[last]]]] = 0x80  # white space that ends a text is a unit
    sums, begins = running(ends), first_bytes(data)
    before = sums[words]
    n = np.diff(before)
    a, b = one % (n + 1), two % (n + 1)
    points = running(begins)
    base = rank(begins, points, start)
    out = [n]
    for k in (np.minimum(a, b), np.maximum(a, b)):
        at = np.zeros(len(n), np.int64)
        some = k > 0
        at[some] = select(ends, sums, (before[:-1] + k)[some]) + 1 - start[some]
        out += [at, rank(begins, points, start + at) - base]
    return tuple(out)


def _arranger(marks: tuple[str, str, str]) -> Callable:
    p, s, m = (x.encode() for x in marks)

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view, offsets = texts_of(batch.column("text"))
            one, two = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            for i, j in blocks(offsets):
                texts = [bytes(view[offsets[k]:offsets[k + 1]]) for k in range(i, j)]
                n, at, before, to, upto = cuts(texts, one[i:j], two[i:j])
                forms = batch.column("form").slice(i, j - i)
                out = [t if f == "plain"
                       else b"".join((p, t[:a], s, t[b:], m, t[a:b]) if f == "psm" else (s, t[b:], p, t[:a], m, t[a:b]))
                       for t, f, a, b in zip(texts, forms.to_pylist(), at.tolist(), to.tolist(), strict=True)]
                plain = pa.compute.equal(forms, "plain").to_numpy(zero_copy_only=False)
                yield pa.record_batch(
                    [batch.column("key").slice(i, j - i), pa.array(n, pa.int64()), forms,
                     pa.array(before, pa.int64(), mask=plain), pa.array(upto - before, pa.int64(), mask=plain),
                     pa.array(out, pa.binary()).view(pa.string())],
                    ["key", "n", "form", "prefix_chars", "middle_chars", "output"])
    return arrange


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that cannot arise across a seam: distinct, and what starts one stands nowhere else in any."""
    if len(set(marks)) < 3 or not all(marks) or any(m[0] in x[1:] or m[0] != x[0] for m in marks for x in marks):
        raise ValueError("marks must differ, and start with one character that they hold nowhere else")
    return marks


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50,
                   percent_spm: int = 80, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Per row of docs: key, n (units), form, prefix_chars and middle_chars (code points), output.

    Which texts are rearranged and where they are cut follows from the SHA-256 of "seed:key", so
    every run and every partitioning gives the same. `percent` of the texts leave form plain, of
    these `percent_spm` become spm (suffix, prefix, middle), the others psm. Null and empty texts
    and those that hold a mark stay plain, whatever the draw; a null text counts as empty, and a
    plain row's output is its text with null lengths. A null key draws as the empty string. Rows
    that repeat give rows that repeat; other columns are not read, so their names cannot clash.
    """
    p, s, m = _checked(marks)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("text"), digest.alias("digest"))
    draw = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    plain = (F.col("text") == "") | F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m) \
        | (draw[2] % 100 >= percent)
    form = F.when(plain, "plain").when(draw[3] % 100 < percent_spm, "spm").otherwise("psm")
    rows = rows.select("key", "text", form.alias("form"), draw[0].alias("h1"), draw[1].alias("h2"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_arranger(marks), f"key {kind}, n long, form string, prefix_chars long, "
                                             "middle_chars long, output string").withColumnRenamed("key", key)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text of a row of `fill_in_middle`, from its output and form alone; null for a null output."""
    pattern = "|".join(f"\\Q{m}\\E" for m in _checked(marks))
    parts = F.split(output, pattern, 4)  # what is before the first mark is empty
    joined = let(parts, lambda x: F.when(form == "psm", F.concat(x[1], x[3], x[2])).otherwise(F.concat(x[2], x[3], x[1])))
    return F.when(form == "plain", output).otherwise(joined)
