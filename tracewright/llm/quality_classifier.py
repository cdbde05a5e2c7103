"""Quality classifier: logistic regression on hashed word n-grams, learnt with follow-the-regularised-leader."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, arrow_types, held_out, map_arrow, mix, word_list
from .training import training_sample

BITS = 20
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
EPOCHS = 3
SCALE = 8.0  # values of a family of n-grams sum to this
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def _shape(text: str) -> str:
    """Case and marks of a word, runs written once: ``Ab,`` is ``Xx,`` and ``AB!!`` is ``X!``."""
    classes = ("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in text)
    return re.sub(r"(.)\1+", r"\1", "".join(classes), flags=re.S)[:8]


def _hashes(word: bytes) -> bytes:
    text = word.decode()
    return struct.pack("<QQ", xxhash.xxh64_intdigest(text.lower(), 7), xxhash.xxh64_intdigest(_shape(text), 11))


class Grams:
    """Families of n-grams of a text: words and their shapes, one to three in a row, as feature numbers."""

    def __init__(self) -> None:
        self.words = Remembered(_hashes)

    def __call__(self, text: str | None) -> list[np.ndarray]:
        words = word_list(text)
        if not words:
            return []
        raw = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u8").reshape(-1, 2)
        word, shape = raw[:, 0], raw[:, 1].copy()
        shape[1:][word[1:] == word[:-1]] = 1  # a word said twice has a shape of its own
        prime = np.uint64(0x9E3779B97F4A7C15)
        two, pair = word[:-1] * prime + word[1:], shape[:-1] * prime + shape[1:]
        three = pair[:-1] * prime + shape[2:]
        families = (word, two, shape, pair, three)
        return [(mix(f + np.uint64(k)) & np.uint64((1 << BITS) - 1)).astype(np.int64) for k, f in enumerate(families) if len(f)]


def sparse(families: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text and their values."""
    if not families:
        return np.empty(0, np.int64), np.empty(0)
    index, place = np.unique(np.concatenate(families), return_inverse=True)
    value = np.concatenate([np.full(len(f), SCALE / len(f)) for f in families])
    return index, np.bincount(place, value)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights; the last number is the constant's. Rows are taken in their order, EPOCHS times."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        soft = np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0.0)
        return -soft / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for index, value, y in rows:
            i, x = np.append(index, size), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / ALPHA * w
            n[i] = more
    used = np.flatnonzero(n)
    w = weights(used)
    return used[w != 0], w[w != 0]


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights of a model learnt in one task from the bounded training sample; zeros if there is none.

    The model has 2 ** BITS weights and a constant whatever the data's size.
    """
    sample = training_sample(docs, labels, "quality").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        rows = [(*sparse(grams(t.as_py())), y.as_py()) for b in batches for t, y in zip(b.column(0), b.column(1), strict=True)]
        index, weight = learn(rows)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(weight)], names=["index", "weight"])

    model = np.zeros((1 << BITS) + 1)
    for row in map_arrow(sample, run, "index long, weight double").collect():
        model[row["index"]] = row["weight"]
    return model


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text: a dot product with its n-grams, null and empty ones the constant."""
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    arrow = arrow_types(SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, w = Grams(), shared.value
        for batch in batches:
            sums = [float(w[-1]) + SCALE * sum(float(w[f].mean(dtype=np.float64)) for f in grams(t.as_py())) for t in batch.column(1)]
            p = 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=arrow
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    return map_arrow(columns, run, SCORED)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows not held out and score every row. Repeated rows score alike; an empty table gives none."""
    return score(docs, fit(docs, labels))
