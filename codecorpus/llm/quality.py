"""Quality scores from a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .textbytes import blocks, texts_of, words

FEATURES = ("chars", "words", "word_length", "upper", "lower", "digits", "stops", "marks", "exclaims",
            "bars", "breaks", "wide", "distinct", "doubled")
#: Byte classes counted per text: name and bytes.
_CLASSES = (
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b".,;:'\"-?()",
    b"#$%&*+/<=>@[\\]^_`{}~", b"!", b"|", b"\n\r", bytes(range(128, 256)),
)


def statistics(view: memoryview, offsets: np.ndarray, i: int, j: int) -> np.ndarray:
    """Transformed statistics of rows i to j: logarithms of sizes, square roots of shares."""
    n = j - i
    data = np.frombuffer(view[offsets[i]:offsets[j]], np.uint8)
    bounds = offsets[i:j + 1] - offsets[i]
    size = np.diff(bounds).astype(float)
    kind = np.full(256, len(_CLASSES), np.uint8)
    for k, members in enumerate(_CLASSES):
        kind[list(members)] = k
    kinds = kind[data]
    counts = np.zeros((n, len(_CLASSES)))
    for k in range(len(_CLASSES)):
        counts[:, k] = np.diff(np.concatenate([[0], np.cumsum(kinds == k)])[bounds])
    hashes, at = words(view, offsets, i, j)
    tokens = np.diff(at).astype(float)
    distinct, doubled = np.zeros(n), np.zeros(n)
    for k in range(n):
        own = hashes[at[k]:at[k + 1]]
        distinct[k] = len(np.unique(own))
        doubled[k] = np.count_nonzero(own[1:] == own[:-1])
    some = np.maximum(tokens, 1)
    out = [np.log1p(size), np.log1p(tokens), np.log1p(size / some)]
    out += [np.sqrt(counts[:, k] / np.maximum(size, 1)) for k in range(len(_CLASSES))]
    out += [np.log1p(distinct) - np.log1p(tokens), np.sqrt(doubled / some)]
    return np.stack(out, axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        view, offsets = texts_of(batch.column("text"))
        for i, j in blocks(offsets):
            x = statistics(view, offsets, i, j)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch([batch.column("row").slice(i, j - i), lists], ["row", "features"])


def measured(docs: DataFrame) -> DataFrame:
    """(row, features): a struct of the columns of docs but text, and the statistics of the text."""
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"),
                       F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_measure, f"row {kind}, features array<double>")


@dataclass
class Model:
    """Per class: log prior, mean, inverse Cholesky factor of the covariance, log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in range(2):
            z = (x - self.mean[k]) @ self.whiten[k].T
            density.append(self.prior[k] - 0.5 * self.logdet[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(examples: DataFrame, shrinkage: float = 0.1, floor: float = 1e-4) -> Model:
    """A model from (label 0 or 1, features); other labels and nulls are left out.

    Counts, sums and cross products are added up in the tasks; the driver gets one number per
    class and pair of features. Each class covariance is drawn by `shrinkage` to the diagonal of
    the pooled one, whose entries are at least `floor`. A class without examples takes the
    other's moments; without any example the score is 0.5.
    """
    p = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            x = batch.column("features").flatten().to_numpy().reshape(-1, p)
            for k in range(2):
                own = x[label == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for k in range(2):
            yield pa.record_batch([pa.array([k] * sums.shape[1]), pa.array(np.arange(sums.shape[1])), pa.array(sums[k])],
                                  ["label", "at", "value"])

    rows = (examples.filter("label in (0, 1) and features is not null").select("label", "features")
            .mapInArrow(moments, "label long, at long, value double").groupBy("label", "at").agg(F.sum("value")).collect())
    sums = np.zeros((2, 1 + p + p * p))
    for label, at, value in rows:
        sums[label, at] = value
    n = sums[:, 0]
    if not n.sum():
        return Model(np.zeros(2), np.zeros((2, p)), np.stack([np.eye(p)] * 2), np.zeros(2))
    for k in range(2):
        if not n[k]:
            sums[k] = sums[1 - k]
    mean = sums[:, 1:1 + p] / sums[:, :1]
    cov = sums[:, 1 + p:].reshape(2, p, p) / sums[:, :1, None] - mean[:, :, None] * mean[:, None, :]
    weight = sums[:, 0] / sums[:, 0].sum()
    target = np.diag(np.maximum(np.einsum("k,kii->i", weight, cov), floor))
    factors = [np.linalg.cholesky((1 - shrinkage) * cov[k] + shrinkage * target) for k in range(2)]
    return Model(np.log((n + 1) / (n.sum() + 2)), mean, np.stack([np.linalg.inv(f) for f in factors]),
                 np.array([2 * np.log(np.diag(f)).sum() for f in factors]))


def _scorer(model: Model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column("row"), pa.array(model.score(x))], ["row", "score"])
    return score


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the doc_id as text leaves 0 when divided by 5; a null id is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without text, plus held_out and score: how likely label 1 is, from the text alone.

    The model learns from labelled rows that are not held out, all of them; rows that repeat
    count as often as they stand there. Null texts are empty and scored like any other. Columns
    of docs called score or held_out give way.
    """
    docs = docs.drop("score", "held_out")
    rows = stored(measured(docs), "features")
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).filter(
        ~held_out(F.col("_id")))
    examples = rows.select(F.col("row.doc_id").alias("_id"), "features").join(marks, "_id")
    model = fit(examples)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model), f"row {kind}, score double").select(
        "row.*", held_out(F.col("row.doc_id")).alias("held_out"), "score")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs whose score reaches the threshold, with the texts they came with."""
    rows = measured(docs)
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).filter(
        ~held_out(F.col("_id")))
    model = fit(stored(rows.select(F.col("row.doc_id").alias("_id"), "features"), "features").join(marks, "_id"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view, offsets = texts_of(batch.column("text"))
            good = [model.score(statistics(view, offsets, i, j)) >= threshold for i, j in blocks(offsets)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(keep, docs.schema)
