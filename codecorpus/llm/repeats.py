"""Removal of long repeated byte strings with a run-length index of the candidate text.

Every window of `window` bytes belongs to the least of the grams it holds (by hash, leftmost on
ties), so equal windows belong to equal grams. Consecutive windows of one gram form a stretch.
Stretches whose gram stands once in the corpus hold no repeat and go no further. The distinct
stretches of the other grams are gathered by gram and indexed: their suffix order gives a
run-length Burrows-Wheeler transform, and longest matches are computed at the ends of its runs
only. Streaming over the text extends them to every position, and positions whose longest
match with another place reaches `window` are marked. All other work is on hashes and offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pieces_for, stored
from .textbytes import TILE, U64, mix, powers, prefix_sums, range_hash, texts_of

WINDOW, GRAM = 200, 32
#: Distinct stretches of one gram beyond which they are gone through again by longer grams.
MOST_KINDS = 2048
#: Bytes of stretches in one index.
INDEX_BYTES = 1 << 19
_SHIFT = 1 << 20


def _tiles(offsets: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Lists of (row, place in the row, first byte, last byte), about TILE bytes each.

    Longer rows are cut into tiles that overlap by window - 1 bytes, so that every window lies
    in one tile.
    """
    held, size = [], 0
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        for t in range(0, max(b - a - window + 1, 0), TILE):
            end = min(a + t + TILE + window - 1, b)
            held.append((row, t, a + t, end))
            size += end - a - t
            if size >= TILE:
                yield held
                held, size = [], 0
    if held:
        yield held


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def stretches(data: np.ndarray, bounds: np.ndarray, window: int, gram: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, gram hash and body hash of the stretches of concatenated tiles."""
    sums = prefix_sums(data)
    n = len(data) - gram + 1
    grams = mix((sums[gram:] - sums[:-gram]) * powers(len(sums))[1][:n])
    least = sliding_min(grams, window - gram + 1)
    first = np.ones(len(least), bool)
    first[1:] = (least[1:] != least[:-1]) | (grams[:len(least) - 1] == least[:-1])
    first[bounds[:-1]] = True
    spans = np.diff(bounds) - window + 1
    at = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
    heads = np.flatnonzero(first[at])
    count = np.diff(np.append(heads, len(at)))
    start = at[heads]
    return start, count, least[start], range_hash(sums, start, start + count + window - 1)


def _scanner(window: int, gram: int) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            view, offsets = texts_of(batch.column(1))
            for tiles in _tiles(offsets, window):
                data = np.frombuffer(b"".join(view[a:b] for _, _, a, b in tiles), np.uint8)
                bounds = np.cumsum([0, *(b - a for _, _, a, b in tiles)])
                start, count, key, body = stretches(data, bounds, window, gram)
                tile = np.searchsorted(bounds, start, "right") - 1
                row, place = np.array([(r, t) for r, t, _, _ in tiles], np.int64).T
                yield pa.record_batch([
                    pa.array(rid[row[tile]]), pa.array((place[tile] + start - bounds[tile]) * _SHIFT + count),
                    pa.array(key.view(np.int64)), pa.array(body.view(np.int64))], ["rid", "at", "gram", "body"])
    return scan


def suffix_order(code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of concatenated strings in order, and ranks of their first 7, 14, 28... codes.

    left: codes until the string ends. Suffixes end with their string; equal ones go by place.
    """
    n = len(code)
    key = np.zeros(n, np.int64)
    for t in range(7):
        key <<= 9
        key[:n - t] += np.where(left[:n - t] > t, code[t:].astype(np.int64), 0)
    levels, h = [], 7
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        levels.append((h, rank))
        if h >= left.max(initial=0) or rank.max(initial=0) == n:
            return order, levels
        after = np.zeros(n, np.int64)
        after[:n - h] = np.where(left[:n - h] > h, rank[h:], 0)
        key = rank * (n + 1) + after
        h *= 2


def longest_matches(strings: list[bytes]) -> np.ndarray:
    """For each byte of the concatenated strings, the longest match with any other place.

    The transform's runs are maximal stretches of equal preceding codes in suffix order. Within a
    run, neighbours in that order stay neighbours one place further left, with a match longer
    by one. So matches are measured only left of run ends, and run on from there.
    """
    code = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    sizes = np.array([len(s) for s in strings])
    n = len(code)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    order, levels = suffix_order(code, left)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.where(order > 0, code[order - 1], 0)
    before[np.isin(order, np.cumsum(sizes) - sizes)] = 0  # a string's first byte follows nothing
    breaks = np.ones(n + 1, bool)
    breaks[1:-1] = (before[1:] != before[:-1]) | (before[1:] == 0)
    longest = np.zeros(n, np.int64)
    for ends, step in ((breaks[:-1], -1), (breaks[1:], 1)):
        sampled = np.zeros(n + 1, bool)
        sampled[order[ends]] = True  # the place left of these is measured
        sampled = np.flatnonzero(sampled[1:] | (left == 1))
        near = rank[sampled] + step
        has = (near >= 0) & (near < n)
        length = np.zeros(len(sampled), np.int64)
        length[has] = _common(sampled[has], order[near[has]], code, left, levels)
        place = np.arange(n)
        at = np.searchsorted(sampled, place)
        longest = np.maximum(longest, length[at] + sampled[at] - place)
    return longest


def _common(i: np.ndarray, j: np.ndarray, code: np.ndarray, left: np.ndarray,
            levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Lengths of the common prefixes of suffixes i and j."""
    room = np.minimum(left[i], left[j])
    got = np.zeros(len(i), np.int64)
    top = len(code) - 1
    for h, rank in reversed(levels):
        same = (got + h <= room) & (rank[np.minimum(i + got, top)] == rank[np.minimum(j + got, top)])
        got += np.where(same, h, 0)
    on = np.ones(len(i), bool)
    for _ in range(levels[0][0]):
        on &= (got < room) & (code[np.minimum(i + got, top)] == code[np.minimum(j + got, top)])
        got += on
    return got


def covered(marked: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Merged byte ranges of the windows that start at the marked places (ascending)."""
    if not len(marked):
        return []
    cut = np.flatnonzero(np.diff(marked) > window)
    starts = marked[np.concatenate([[0], cut + 1])]
    ends = marked[np.concatenate([cut, [len(marked) - 1]])] + window
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def _cutter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for text, wanted in zip(f["text"], f["wanted"], strict=True):
            raw = text.encode() if isinstance(text, str) else text
            rows += [(w["gram"], w["body"], w["times"], w["kinds"], raw[w["start"]:w["end"]]) for w in wanted]
        yield pd.DataFrame(rows, columns=["gram", "body", "times", "kinds", "bytes"])


def _indexer(window: int) -> Callable:
    """Streams stretches sorted by gram; those of whole grams are indexed together."""
    def marks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["gram", "body"])  # equal rows of the table cut the same stretch
        strings = rows["bytes"].tolist()
        sizes = np.array([len(s) for s in strings])
        ends = np.cumsum(sizes)
        hit = longest_matches(strings) >= window
        hit |= np.repeat(rows["times"].to_numpy() > 1, sizes) & (
            np.repeat(ends, sizes) - np.arange(len(hit)) >= window)
        out = []
        for k in range(len(strings)):
            spans = covered(np.flatnonzero(hit[ends[k] - sizes[k]:ends[k]]), window)
            if spans:
                out.append((rows["gram"].iat[k], rows["body"].iat[k], spans))
        return pd.DataFrame(out, columns=["gram", "body", "spans"])

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if f.empty:
                continue
            rows = pd.concat([*held, f], ignore_index=True)
            size = rows["bytes"].str.len().cumsum().to_numpy()
            gram = rows["gram"].to_numpy()
            ends = np.flatnonzero(np.append(gram[1:] != gram[:-1], False)) + 1  # the last gram may go on
            done = 0
            for e in ends.tolist():
                if size[e - 1] - (size[done - 1] if done else 0) >= INDEX_BYTES:
                    yield marks(rows.iloc[done:e])
                    done = e
            held = [rows.iloc[done:]]
        if held and len(held[0]):
            yield marks(held[0])
    return index


def next_gram(window: int, gram: int) -> int:
    """A gram that leaves few windows to a stretch; then the window itself, which has one stretch each."""
    return window if gram >= window * 4 // 5 else window * 4 // 5


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(rid, spans): byte ranges covered by strings of `window` bytes that start elsewhere too.

    docs: (rid, text), equal rids standing for equal rows. Spans of a row may overlap. A gram in
    very many surroundings, such as a common line, is settled by a second pass over its
    stretches with longer grams, so that no index has to hold them all.
    """
    anchors = stored(docs.mapInArrow(_scanner(window, gram), "rid long, at long, gram long, body long"), "stretches")
    many = anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    shared = stored(anchors.join(many, "gram", "left_semi"), "shared")
    start = F.shiftright("at", _SHIFT.bit_length() - 1)
    end = start + F.col("at").bitwiseAND(_SHIFT - 1) + (window - 1)
    kinds = shared.groupBy("gram", "body").agg(
        F.count("*").alias("times"), F.min("rid").alias("rid"), F.min_by("at", "rid").alias("at"))
    kinds = stored(kinds, "kinds")
    amount = kinds.groupBy("gram").agg(F.count("*").alias("kinds"))
    kinds = kinds.join(amount, "gram")
    span = "array<struct<start:long,end:long>>"
    marks = kinds.filter("kinds = 1").select("gram", "body", F.array(F.struct(
        F.lit(0).cast("long").alias("start"), (end - start).alias("end"))).cast(span).alias("spans"))
    mixed = stored(kinds.filter("kinds > 1").withColumns({"start": start, "end": end}), "mixed")

    facts = mixed.agg(F.max("kinds"), F.sum(F.col("end") - F.col("start"))).first()
    if facts[0]:
        wanted = mixed.groupBy("rid").agg(F.collect_list(
            F.struct("gram", "body", "times", "kinds", "start", "end")).alias("wanted"))
        cut = stored(docs.join(wanted, "rid").select("text", "wanted").mapInPandas(
            _cutter, "gram long, body long, times long, kinds long, bytes binary"), "cut")
        parts = pieces_for(facts[1], 4 * INDEX_BYTES)
        cold = cut.filter(F.col("kinds") <= MOST_KINDS).select("gram", "body", "times", "bytes")
        marks = marks.union(cold.repartition(max(parts, 8), "gram").sortWithinPartitions("gram").mapInPandas(
            _indexer(window), f"gram long, body long, spans {span}"))
        if facts[0] > MOST_KINDS:
            hot = cut.filter(F.col("kinds") > MOST_KINDS).withColumn("rid", F.xxhash64("gram", "body"))
            whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("bytes").cast("long").alias("end")))
            deeper = repeated_spans(hot.select("rid", F.col("bytes").alias("text")), window, next_gram(window, gram))
            marks = marks.union(hot.filter("times > 1").select("gram", "body", whole.cast(span))).union(
                hot.filter("times = 1").join(deeper, "rid").select("gram", "body", "spans"))
    found = shared.join(marks, ["gram", "body"]).select("rid", F.transform("spans", lambda s: F.struct(
        (s["start"] + start).alias("start"), (s["end"] + start).alias("end"))).alias("spans"))
    return found.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _remover(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        view, offsets = texts_of(batch.column("text"))
        spans = batch.column("spans")
        bound = spans.offsets.to_numpy()
        flat = spans.flatten()
        starts, ends = (flat.field(k).to_numpy() for k in (0, 1))
        base = bound[0] if len(bound) else 0
        kept, runs = [], []
        for k in range(batch.num_rows):
            raw = view[offsets[k]:offsets[k + 1]]
            a, b = bound[k] - base, bound[k + 1] - base
            if not spans[k].is_valid or a == b:
                kept.append(bytes(raw))
                runs.append([])
                continue
            order = np.argsort(starts[a:b], kind="stable")
            s, reach = starts[a:b][order], np.maximum.accumulate(ends[a:b][order])
            head = np.flatnonzero(np.append(True, s[1:] > reach[:-1]))
            s, e = s[head], np.append(reach[head[1:] - 1], reach[-1])
            kept.append(b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)))
            runs.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
        yield pa.record_batch([
            batch.column("row"),
            pa.array([k.decode(errors="ignore") for k in kept]) if as_text else pa.array(kept, pa.binary()), pa.array(np.diff(offsets)),
            pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["row", "kept", "n_bytes", "spans"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, as_text: bool = False) -> DataFrame:
    """docs without their text, plus kept (the bytes that stay), n_bytes and spans (what was cut).

    With as_text, kept is a string, without the halves of characters cut in two.

    Cut is each byte covered by a string of `window` bytes that also starts anywhere else, in
    the same text or another; all occurrences go. Matches never cross texts and are judged on
    the input. Spans are maximal, ascending and may leave a UTF-8 character cut in half.

    Null texts are empty, with n_bytes 0 and no spans, like every text under `window` bytes. Rows
    that repeat match each other and lose whatever lies in a window. Columns of docs called row,
    rid, kept, n_bytes or spans give way to the operator's own. Any doc_id, null too, is carried.
    """
    others = [c for c in docs.columns if c not in ("text", "kept", "n_bytes", "spans", "row", "rid")]
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.struct(*others).alias("row"))
    spans = repeated_spans(rows.select("rid", "text"), window)
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.join(spans, "rid", "left").select("row", "text", "spans").mapInArrow(
        lambda batches: _remover(batches, as_text),
        f"row {kind}, kept {'string' if as_text else 'binary'}, n_bytes long, spans array<struct<start:long,end:long>>")
    return out.select("row.*", "kept", "n_bytes", "spans")


def cut_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with what stays of each text, and n_chars to match."""
    out = remove_repeats(docs, window, as_text=True).withColumn("text", F.col("kept"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(
        *dict.fromkeys([*docs.columns, "n_chars"]))
