"""Packing of lengths into sequences: dominance reduction, then best fit, on a histogram.

Only how many pieces there are of each length matters, so a plan over at most `capacity`
lengths fits any number of pieces. The plan fixes dominating sets first, as Martello and Toth
do, whole multiplicities at a time; what is left goes best-fit decreasing. Pieces then find their
place by their rank among the pieces of their length, which is counted in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import pieces_for, stored

#: A kind of sequence: [(length, how many of it)] in order, and how many such sequences.
Pattern = tuple[tuple[tuple[int, int], ...], int]
RANK_ROWS = 100_000


class _Left:
    """Counts by length, with the next smaller and larger length that still has pieces."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 2, np.int64)
        for length, count in counts.items():
            self.n[length] = count

    def at_most(self, length: int) -> int:
        """The largest length with pieces not over `length`; 0 if none."""
        found = np.flatnonzero(self.n[1:max(length, 0) + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def least(self, k: int) -> list[int]:
        """The k smallest lengths, with repetition; fewer if there are not so many."""
        out: list[int] = []
        for length in np.flatnonzero(self.n).tolist():
            out += [length] * int(min(self.n[length], k - len(out)))
            if len(out) == k:
                break
        return out

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.n[length] -= times


def reduce(left: _Left, capacity: int) -> list[Pattern]:
    """Sets that dominate every other set holding their largest piece, fixed and removed.

    For the largest piece j: alone if nothing fits beside it; with the largest j* that fits, if
    no two fit together beside j, or if j and j* fill the sequence; with j*, if at most two fit and
    j* is no smaller than the best such pair. The pieces of one length are fixed together. A
    length without a dominating set is passed over, and lengths are gone through again while
    that fixes something, since removals can open other reductions.
    """
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while left.n[j]:
                chosen = _dominating(left, j, capacity)
                if chosen is None:
                    break
                each = {x: chosen.count(x) for x in chosen}
                times = int(min(left.n[x] // k for x, k in each.items()))
                if not times:
                    break
                left.take(chosen, times)
                fixed.append((tuple(sorted(each.items(), reverse=True)), times))
                again = True
    return fixed


def _dominating(left: _Left, j: int, capacity: int) -> tuple[int, ...] | None:
    room = capacity - j
    left.n[j] -= 1  # the piece itself is not its own partner
    try:
        best = left.at_most(room)
        if not best:
            return (j,)
        if best == room:
            return (j, best)
        small = left.least(3)
        if len(small) < 2 or small[0] + small[1] > room:
            return (j, best)
        if (len(small) < 3 or sum(small) > room) and best >= _best_pair(left, room):
            return (j, best)
        return None
    finally:
        left.n[j] += 1


def _best_pair(left: _Left, room: int) -> int:
    """The largest sum of two pieces not over `room`."""
    top = 0
    for a in np.flatnonzero(left.n[:room]).tolist():
        left.n[a] -= 1
        b = left.at_most(min(room - a, a))
        left.n[a] += 1
        if b:
            top = max(top, a + b)
    return top


def best_fit(left: _Left, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: equal sequences are filled together."""
    open_: dict[int, list[list]] = {}  # room -> [[contents, how many]]
    for length in range(capacity, 0, -1):
        n = int(left.n[length])
        while n:
            room = next((r for r in sorted(open_) if r >= length), None)
            if room is None:
                room, group = capacity, [(), -(-n // (capacity // length))]
            else:
                group = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            contents, many = group
            fit = room // length  # best fit goes on with the sequence it has just made fuller
            full = min(many, n // fit)
            rest = n - full * fit if full < many else 0
            if full:
                open_.setdefault(room - fit * length, []).append([(*contents, (length, fit)), full])
            if rest:
                rest = min(rest, fit)
                open_.setdefault(room - rest * length, []).append([(*contents, (length, rest)), 1])
            spare = many - full - (1 if rest else 0)
            if spare and contents:
                open_.setdefault(room, []).append([contents, spare])
            n -= full * fit + rest
        left.n[length] = 0
    return [(c, m) for groups in open_.values() for c, m in groups]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    left = _Left(counts, capacity)
    fixed = reduce(left, capacity)
    return fixed + best_fit(left, capacity)


def _slots(patterns: list[Pattern]) -> pd.DataFrame:
    """Rows (length, first rank, end, first sequence, offset, many): who sits where."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for contents, times in patterns:
        offset = 0
        for length, many in contents:
            start = used.get(length, 0)
            used[length] = start + many * times
            rows.append((length, start, used[length], sequence, offset, many))
            offset += many * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "start", "end", "sequence", "offset", "many"])


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...]) -> DataFrame:
    """pieces (with a long column `length` from 1 to capacity) plus sequence_id and offset.

    `order` names columns that tell pieces apart; ties among equal rows are broken by any order,
    since such rows are alike. The plan holds the counts of at most `capacity` lengths and, per
    length, a few kinds of sequence; it is all that goes through the driver. An empty input gives
    an empty result. Null lengths and lengths outside 1 to capacity are an error.
    """
    pieces = stored(pieces, "pieces")
    facts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    bad = [r["length"] for r in facts if r["length"] is None or not 1 <= r["length"] <= capacity]
    if bad:
        raise ValueError(f"lengths outside 1 to {capacity}: {bad[:5]}")
    slots = _slots(plan({r["length"]: r["count"] for r in facts}, capacity))
    parts = pieces_for(sum(r["count"] for r in facts), RANK_ROWS)
    keyed = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = keyed.groupBy("length", "_part").count()
    base = counts.withColumn("_base", F.sum("count").over(
        Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = keyed.withColumn("_rank", F.row_number().over(
        Window.partitionBy("length", "_part").orderBy(*order)) - 1)
    ranked = ranked.join(base.select("length", "_part", F.coalesce("_base", F.lit(0)).alias("_base")), ["length", "_part"])
    by_length = {k: g.sort_values("start").to_numpy() for k, g in slots.groupby("length")}

    own_columns = pieces.columns

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rank = (f["_rank"] + f["_base"]).to_numpy(np.int64)
            length = f["length"].to_numpy(np.int64)
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for k in np.unique(length).tolist():
                own = np.flatnonzero(length == k)
                table = by_length[k]
                row = table[np.searchsorted(table[:, 1], rank[own], "right") - 1]
                nth = rank[own] - row[:, 1]
                sequence[own] = row[:, 3] + nth // row[:, 5]
                offset[own] = row[:, 4] + nth % row[:, 5] * k
            yield f[own_columns].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long")
