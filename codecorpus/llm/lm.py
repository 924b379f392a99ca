"""Log probabilities of texts under smoothed n-grams: a weighted backoff automaton.

States are histories that were learnt, arcs are n-grams, and a failure arc leads from a history to
the next shorter one. The weight of an arc comes from Dirichlet smoothing (MacKay and Peto),
(c(hw) + strength * p(w | shorter)) / (c(h) + strength); the weight of a failure arc is
strength / (c(h) + strength). A text is read once from left to right: where the state has no arc for
the token, failure arcs are followed until one has.

No task holds the model. Texts are dealt out in groups. A group asks buckets of n-gram hashes for
the n-grams it holds, in sorted blocks, and brings its own counts along; buckets add up and answer.
From the answers a group builds the part of the automaton that its texts can reach, and walks it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import pieces_for, stored
from .textbytes import TILE, U64, mix, texts_of, words

ORDER, STRENGTH, UNKNOWN = 2, 500.0, 0.5
#: Bytes of text in a group.
GROUP_BYTES = 12 << 20
#: Tokens of a text that one lane of the traversal reads; longer texts are read by several at once.
LANE = 256
START, END = U64(0x51A7), U64(0xE2D5)
_BASE = U64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 62


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences of as few bytes as the widest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=U64(0))
    width = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    width = raw[0]
    low = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(low) + 1, 8), np.uint8)
    steps[1:, :width] = low
    steps = steps.ravel().view(np.uint64)
    steps[0] = np.frombuffer(raw, np.uint64, 1, 1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each followed by an end, and the texts' bounds."""
    view, offsets = texts_of(texts)
    hashes, at = words(view, offsets, 0, len(offsets) - 1)
    n = len(at) - 1
    tokens = np.full(len(hashes) + n, END)
    tokens[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(at))] = hashes
    return tokens, at + np.arange(n + 1)


def _grams(tokens: np.ndarray, bounds: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per length 1 to `order`: the key of the n-gram ending at each token, and whether there is one.

    Histories reach back to one start before each text. Odd keys are single tokens.
    """
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    value = mix(tokens)
    keys, has = [mix(value) | U64(1)], [np.ones(len(tokens), bool)]
    gram = value
    for k in range(1, order):
        past = np.empty_like(value)
        past[k:], past[:k] = value[:-k], 0
        past[place == k - 1] = mix(np.array([START]))[0]
        gram = mix(gram * _BASE + past)
        keys.append(gram & ~U64(1))
        has.append(place >= k - 1)
    return keys, has


def _asked(keys: list[np.ndarray], has: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and where each length's keys stand among them.

    Lengths are sorted one after the other and leave `keys`, so that one length's copies are held at a time.
    """
    each, where = [], []
    for h in has:
        some = keys.pop(0)[h]
        own, place = np.unique(some, return_inverse=True)
        each.append(own)
        where.append(place.astype(np.int32))
        del some, own, place
    asked = np.unique(np.concatenate(each))
    for k, own in enumerate(each):
        where[k] = np.searchsorted(asked, own).astype(np.int32)[where[k]]
    return asked, np.concatenate(where)


def _asker(order: int, buckets: int):
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def ask(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        tokens, bounds = _tokens(table.column("text"))
        keys, has = _grams(tokens, bounds, order)
        del tokens
        asked, where = _asked(keys, has)
        learn = np.repeat(table.column("learn").to_numpy() > 0, np.diff(bounds))
        counts = np.bincount(where[np.concatenate([learn[h] for h in has])], minlength=len(asked))
        cut = [0, *np.searchsorted(asked, edges).tolist(), len(asked)]
        used = [(b, i, j) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
        parts = [(i, j) for _, i, j in used]
        return pa.table({
            "grp": pa.array([group] * len(used), pa.int64()), "bucket": pa.array([b for b, _, _ in used], pa.int64()),
            "keys": pa.array([pack_sorted(asked[a:b]) for a, b in parts], pa.binary()),
            "counts": pa.array([_narrow(counts[a:b]) for a, b in parts], pa.binary())})
    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Adds up a bucket's counts; its first row also says how many single tokens are learnt, and how often."""
    each = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    found, where = np.unique(np.concatenate(each), return_inverse=True)
    total = np.bincount(where, np.concatenate([_wide(c) for c in table.column("counts").to_pylist()]), len(found))
    single = total[(found & U64(1)).astype(bool)]
    answers = np.split(total[where].astype(np.uint64), np.cumsum([len(k) for k in each])[:-1])
    rest = [0] * (len(each) - 1)
    return pa.table({
        "grp": table.column("grp"), "bucket": table.column("bucket"),
        "totals": pa.array([_narrow(a) for a in answers], pa.binary()),
        "distinct": pa.array([int(np.count_nonzero(single)), *rest], pa.int64()),
        "tokens": pa.array([int(single.sum()), *rest], pa.int64())})


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type that holds them, named by a first byte."""
    kind = next(t for t in ("u1", "u2", "u4", "u8") if counts.max(initial=0) <= np.iinfo(t).max)
    return kind[1].encode() + counts.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[:1].decode()}", offset=1)


class Automaton:
    """The states and arcs that the texts of a group can reach.

    `arcs` holds, per length 1 to order, the number of the n-gram that ends at each token, or -1 where
    the text is too short; `count` says how often the n-grams were learnt. The state of a history
    has the number of its n-gram; two more are the start of a text and the root.
    """

    def __init__(self, arcs: np.ndarray, bounds: np.ndarray, count: np.ndarray, tokens: int, distinct: int,
                 strength: float):
        order, n = len(arcs), len(count)
        self.arcs, self.bounds, self.strength, self.start, self.root = arcs, bounds, strength, n, n + 1
        begins, ends = bounds[:-1], bounds[1:] - 1
        texts = count[arcs[0, ends[:1]]]  # texts learnt: what the start is followed by
        self.count = count = np.concatenate([count, np.resize(texts, 1), np.zeros(1, count.dtype)])
        self.depth = np.zeros(n + 2, np.int8)
        self.depth[n] = 1
        self.fail = np.full(n + 2, n + 1, arcs.dtype)
        self.weight = np.zeros(n + 2)
        self.depth[arcs[0]] = 1
        self.weight[arcs[0]] = (count[arcs[0]] + UNKNOWN) / (tokens + UNKNOWN * (distinct + 1))
        for k in range(1, order):  # an arc rests on the arc of its failure state for the same token
            history = np.roll(arcs[k - 1], 1)
            history[begins] = n
            for at in range(0, len(history), TILE):
                use = arcs[k, at:at + TILE] >= 0
                arc, shorter, past = arcs[k, at:at + TILE][use], arcs[k - 1, at:at + TILE][use], history[at:at + TILE][use]
                self.weight[arc] = (count[arc] + strength * self.weight[shorter]) / (count[past] + strength)
                self.fail[arc], self.depth[arc] = shorter, k + 1

    def target(self, arc: np.ndarray) -> np.ndarray:
        """The states that arcs lead to: the history with the token, or its failure state if it is too long."""
        told = np.where(self.depth[arc] < len(self.arcs), arc, self.fail[arc])
        return np.where(self.count[arc] > 0, told, self.root)

    def walk(self) -> np.ndarray:
        """The log10 weight that each token adds, texts read from left to right and many at a time.

        A text of more than LANE tokens is read by several lanes. All but its first begin at the root as
        many tokens early as a state remembers, which leads them to the state they would have come with.
        """
        begins, size = self.bounds[:-1], np.diff(self.bounds)
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        first = begins[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        last = np.minimum(first + LANE, self.bounds[1:][text])
        early = np.maximum(first - (len(self.arcs) - 1), begins[text])
        longest = np.argsort(early - last, kind="stable")
        first, last, early = first[longest], last[longest], early[longest]
        fresh = early == begins[text[longest]]
        state = np.where(fresh & (len(self.arcs) > 1), self.start, self.root)
        length, out = last - early, np.zeros(self.arcs.shape[1])
        for step in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -step, "left"))  # lanes that still read
            at, gain, open_ = early[:n] + step, np.zeros(n), np.arange(n)
            while len(open_):
                own = state[open_]
                arc = self.arcs[self.depth[own], at[open_]]
                found = (arc >= 0) & ((self.count[arc] > 0) | (own == self.root))
                go, arc = open_[found], arc[found]
                gain[go] += np.log10(self.weight[arc])
                state[go] = self.target(arc)
                open_, own = open_[~found], own[~found]
                gain[open_] += np.log10(self.strength / (self.count[own] + self.strength))
                state[open_] = self.fail[own]
            told = at >= first[:n]
            out[at[told]] = gain[told]
        return out


def _scorer(order: int, strength: float, n: int, distinct: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return docs.select(["doc_id"]).slice(0, 0)
        tokens, bounds = _tokens(docs.column("text"))
        keys, has = _grams(tokens, bounds, order)
        n_tokens = len(tokens)
        del tokens
        _, where = _asked(keys, has)
        arcs = np.full((order, n_tokens), -1, np.int32)
        arcs[np.array(has)] = where
        del where, has
        count = np.concatenate([_wide(a) for a in answers.sort_by("bucket").column("totals").to_pylist()])
        add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has its end token
        known = count[arcs[0]]
        n_known = add((known > 0).astype(np.int64))
        base = add(np.log10((known + UNKNOWN) / (n + UNKNOWN * (distinct + 1))))
        del known
        weights = add(Automaton(arcs, bounds, count, n, distinct, strength).walk())
        size = np.diff(bounds)
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_tokens": pa.array(size), "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(len(size), n)),
            "base_score": pa.array(base), "score": pa.array(weights)})
    return score


def scored(docs: DataFrame, learn: Column, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    The model learns from all rows for which `learn` holds (null: not). Tokens are the words
    `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, and one end per text. base_score adds up
    log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens, score the automaton's log10 weights.
    Null texts are empty: one end token. Rows that repeat are learnt and scored each time; ids,
    null too, are carried only. If nothing is learnt, all tokens are unknown and V and N are 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(learn, F.lit(False)).cast("int").alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    groups = pieces_for(size or 0, GROUP_BYTES)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))).repartition(groups, "grp")
    asked = rows.groupBy("grp").applyInArrow(_asker(order, groups), "grp long, bucket long, keys binary, counts binary")
    told = stored(asked.repartition(groups, "bucket").groupBy("bucket").applyInArrow(
        _answer, "grp long, bucket long, totals binary, distinct long, tokens long"), "counts")
    n, distinct = told.agg(F.sum("tokens"), F.sum("distinct")).first()
    return rows.groupBy("grp").cogroup(told.select("grp", "bucket", "totals").repartition(groups, "grp").groupBy("grp")).applyInArrow(
        _scorer(order, strength, n or 0, distinct or 0), "doc_id long, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")
