"""Token ids of whole texts with a public tokenizer that drops white space, and their pieces."""

from __future__ import annotations

import itertools
import json
import os
import re
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import blocks

#: Words and chunks whose ids a worker keeps; beyond that it starts anew.
MOST_KEPT = 500_000
#: Bytes of text whose chunks are found together; a longer text stands alone.
BLOCK = 8 << 20
#: Chunks whose ids are put in a row at a time, and pieces of a batch that leaves.
TILE = 1 << 18
BATCH_PIECES = 8192
#: A special token that no chunk is given to the tokenizer with; it parts the chunks of a batch.
PART = "<|endoftext|>"
#: Marks that may close a word; after a letter they are a token run of their own.
CLOSING = string.punctuation
#: Letters that are composed already and have one letter as lower case (U+0130 has not).
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
LATIN_CHUNK = f"^(?P<word>[{LATIN}]+)(?P<marks>[{re.escape(CLOSING)}]*)$"
LATIN_WORD = re.compile(f"[{LATIN}]+")
#: The tokenizers whose words of letters need no search for runs: composed, in lower case, runs of letters.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _runs(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from begins[k] on, counts[k] of them, for every k in a row."""
    ends = np.cumsum(counts)
    return np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _letters(word: str) -> bool:
    """Whether a word is one run of letters, before and after it is composed and put in lower case."""
    return word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha()


def _parted(chunk: str) -> tuple[str, str]:
    """A word of letters and the marks behind it, each a token run; other chunks are left whole."""
    word = chunk.rstrip(CLOSING)
    return (word, chunk[len(word):]) if _letters(word) else (chunk, "")


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, chunk by chunk between white space.

    Only for tokenizers in which white space always parts tokens and is dropped. Space, tab and
    line ends are such white space, so ids of a text are those of its chunks in a row. A chunk is
    a word and the marks behind it, or one whole; the tokenizer gets each of them once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.latin = self._for_latin(path)
        self.part = self.tokenizer.token_to_id(PART)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _for_latin(self, path: str):
        """The same merges for LATIN words in lower case, which are one run each as they are."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        made = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        runs = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (steps != NORMALIZERS or [x["type"] for x in runs] != ["Split", "ByteLevel"]
                or runs[0]["pattern"] != {"Regex": RUNS} or runs[1]["add_prefix_space"] or runs[1]["use_regex"]):
            return self.tokenizer
        own = Tokenizer.from_file(path)
        own.normalizer = normalizers.Sequence([])
        own.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return own

    def _forget(self) -> None:
        """Only the empty word is known: number 0, without ids."""
        self.known: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, "<u4")
        self.begins, self.counts = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Ids of words and chunks not yet known."""
        latin: list[str] = []
        letters: list[str] = []
        odd: list[str] = []
        rest: list[str] = []
        for w in new:
            if LATIN_WORD.fullmatch(w):
                latin.append(w)
            elif _letters(w):
                letters.append(w)
            else:
                (odd if "<|" in w else rest).append(w)
        parts = [self._words(self.latin, latin), self._words(self.tokenizer, letters), self._chunks(rest)]
        for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False):
            parts.append((np.array(e.ids, "<u4"), np.array([0]), np.array([len(e.ids)])))
        at = len(self.ids) + np.cumsum([0, *(len(ids) for ids, _, _ in parts)])[:-1]
        self.ids = np.concatenate([self.ids, *(ids for ids, _, _ in parts)])
        self.begins = np.concatenate([self.begins, *(k + b for k, (_, b, _) in zip(at.tolist(), parts, strict=True))])
        self.counts = np.concatenate([self.counts, *(c for _, _, c in parts)])
        self.known.update(zip((*latin, *letters, *rest, *odd), range(len(self.known), len(self.counts)), strict=True))

    def _words(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words of letters, and where each word's begin and how many they are."""
        ids = self._joined(tokenizer, words, " ")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            raise RuntimeError("the tokenizer does not keep words apart")
        counts = np.diff(ends, prepend=0)
        return ids, ends - counts, counts

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of any chunks without special tokens."""
        ids = self._joined(self.tokenizer, chunks, PART, PART)
        ends = np.flatnonzero(ids == self.part)
        if len(ends) != len(chunks):
            raise RuntimeError("the tokenizer does not keep chunks apart")
        counts = np.diff(ends, prepend=-1) - 1
        return ids, ends - counts, counts

    @staticmethod
    def _joined(tokenizer, words: list[str], gap: str, close: str = "") -> np.ndarray:
        some = [gap.join(words[i:i + 20_000]) + close for i in range(0, len(words), 20_000)]
        return np.concatenate([np.zeros(0, "<u4"), *(
            np.array(tokenizer.encode_batch_fast([s], add_special_tokens=False)[0].ids, "<u4") for s in some)])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        words = words.dictionary_encode()
        own = words.dictionary.to_pylist()
        new = [w for w in own if w not in self.known]
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))[words.indices.to_numpy()]

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different chunks, and where each chunk's begin and how many they are."""
        found = pc.extract_regex(chunks, LATIN_CHUNK)
        other = pc.is_null(found)
        parted = [_parted(c) for c in chunks.filter(other).to_pylist()]
        both = [pc.utf8_lower(pc.struct_field(found, "word")), pc.struct_field(found, "marks")]
        parts = np.stack([self._numbers(pc.replace_with_mask(x, other, pa.array([p[k] for p in parted], x.type)))
                          for k, x in enumerate(both)], axis=1)
        begins, counts = self.begins[parts], self.counts[parts]
        ids = self.ids[_runs(begins.ravel(), counts.ravel())]
        counts = counts.sum(axis=1)
        return ids, np.cumsum(counts) - counts, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a large_string array without nulls in a row, and len + 1 bounds: text k has those
        from bounds[k] to bounds[k + 1]."""
        if len(self.known) > MOST_KEPT:
            self._forget()
        split = pc.split_pattern(pc.replace_substring_regex(texts, "[\n\t\r]", " "), " ")
        stops = np.cumsum(pc.list_value_length(split).to_numpy())
        chunks = split.flatten().dictionary_encode()
        ids, begins, counts = self._chunk_ids(chunks.dictionary)
        index = chunks.indices.to_numpy()
        before = np.concatenate([[0], np.cumsum(counts[index])])
        tiles = (index[k:k + TILE] for k in range(0, len(index), TILE))
        out = [ids[_runs(begins[x], counts[x])] for x in tiles]
        return np.concatenate([np.zeros(0, "<u4"), *out]), before[np.concatenate([[0], stops])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _piecer(path: str, capacity: int, with_ids: str | None) -> Callable:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
            for i, j in blocks(sizes, BLOCK):
                ids, bounds = tool.encode(texts.slice(i, j - i))
                ids = np.insert(ids, bounds[1:], 0)  # closes each text
                bounds = bounds + np.arange(j - i + 1)
                many = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(j - i), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                cuts = np.append(bounds[row] + piece * capacity, len(ids))
                raw = memoryview(ids).cast("B")
                crc = np.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in itertools.pairwise(cuts.tolist())], np.int64)
                own = ids.astype(with_ids) if with_ids else None
                for k in range(0, len(row), BATCH_PIECES):
                    some = slice(k, k + BATCH_PIECES)
                    columns = [batch.column(0).take(pa.array(i + row[some])), *map(pa.array, (
                        piece[some], piece[some] * capacity, np.diff(cuts)[some], crc[some]))]
                    names = ["row", "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        at = cuts[k:k + BATCH_PIECES + 1]
                        held = pa.array(own[at[0]:at[-1]].view(np.uint8)).buffers()[1]
                        ends = pa.array(((at - at[0]) * own.itemsize).astype(np.int32)).buffers()[1]
                        columns.append(pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, ends, held]))
                        names.append("ids")
                    yield pa.record_batch(columns, names)
        # the worker stays for other stages; pages that Arrow holds but does not use are of no use to them
        pa.default_memory_pool().release_unused()
    return pieces


def pieces(docs: DataFrame, capacity: int, tokenizer: str | None = None, with_ids: str | None = None) -> DataFrame:
    """Per row of docs, its pieces: doc_id, piece, start, length, ids_crc32 and, if wanted, ids.

    A document is the ids of its text, then id 0; only longer ones are cut, every `capacity`
    ids. Null and empty texts are one piece of one id. ids are of the type `with_ids`, the checksum
    is of little-endian unsigned 32-bit ids.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _piecer(tokenizer or default_tokenizer(), capacity, with_ids),
        f"row {kind}, piece long, start long, length long, ids_crc32 long{', ids binary' if with_ids else ''}"
    ).withColumnRenamed("row", "doc_id")
