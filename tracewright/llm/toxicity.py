"""Toxicity: a convolutional classifier over hashed word embeddings, with several filter widths and max pooling."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import Remembered, arrow_types, held_out, map_arrow, word_list
from .training import training_sample

BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6  # at least; a small sample is gone through until MIN_STEPS texts were seen
MIN_STEPS = 12_000
RATE = 0.1
MIN_TEXTS = 3  # words seen in fewer texts of the sample have the embedding zero, as unknown words have
PIECE_WORDS = 1 << 16  # a long text is convolved in pieces of this many words; pooling joins them
FOLD = 0  # the fifth of the sample that is not learnt from
BINS, BIN_EDGE = 16, 480  # thresholds come from counts per sixteenth of a logit, up to 30
MIN_OWN = 30  # texts of either class that a language needs for a threshold of its own
CUT = 0.7
MARKS = ".,!?;:*#$%&|\"'()[]<>-"
SCORED = "doc_id long, held_out boolean, lang string, score double"


def _buckets(word: bytes) -> bytes:
    """Embedding rows of a word: its own, and those of its first four and first five letters."""
    low = word.decode().strip(MARKS).lower()
    return struct.pack("<III", *(xxhash.xxh32_intdigest(f"{k}{low[:n]}") % BUCKETS for k, n in enumerate((None, 4, 5))))


class Words:
    def __init__(self) -> None:
        self.seen = Remembered(_buckets)

    def __call__(self, text: str | None) -> np.ndarray:
        """(words, 3) embedding rows of a text."""
        return np.frombuffer(b"".join(map(self.seen.__getitem__, word_list(text))), "<u4").reshape(-1, 3).astype(np.int32)


class Net:
    """Embedding, one bank of filters per width, the largest response of each filter over the text, and a logistic unit."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        self.banks = [rng.normal(0, 0.5 / np.sqrt(k), (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.known = np.ones(BUCKETS, bool)

    def start(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """Forget the embeddings of rare words; the first coordinate of the others starts from the odds of a text they are in."""
        seen = np.zeros((2, BUCKETS))
        for text, label in zip(rows, y.tolist(), strict=True):
            seen[label, np.unique(text)] += 1
        odds = np.log((seen[1] + 1) / ((y == 1).sum() + 2)) - np.log((seen[0] + 1) / ((y == 0).sum() + 2))
        self.embedding[:, 0] = np.clip(odds / 3, -1, 1)
        self.known = seen.sum(0) >= MIN_TEXTS
        self.embedding[~self.known] = 0

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, *self.banks, *self.biases, self.out, self.bias]

    def blob(self) -> bytes:
        return b"".join(p.tobytes() for p in self.parts())

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        k = WIDTHS[width]
        n = len(x) - k + 1
        return sum(x[j : j + n] @ self.banks[width][j] for j in range(k)) + self.biases[width]

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Largest response per filter, zero at least; a text shorter than a filter is padded with zeros."""
        best, widest = np.zeros((len(WIDTHS), FILTERS), np.float32), max(WIDTHS)
        for at in range(0, max(1, len(rows)), PIECE_WORDS):
            x = self.embedding[rows[at : at + PIECE_WORDS + widest - 1]].sum(1)
            if len(x) < widest:
                x = np.concatenate([x, np.zeros((widest - len(x), DIM), np.float32)])
            for i in range(len(WIDTHS)):
                best[i] = np.maximum(best[i], self.responses(x, i).max(0))
        return best.reshape(-1)

    def logit(self, rows: np.ndarray) -> float:
        return float(self.pooled(rows) @ self.out + self.bias[0])

    def step(self, rows: np.ndarray, y: int, weight: float, sums: list[np.ndarray]) -> None:
        """One step of Adagrad on one text; only the windows that won the pooling have a gradient."""
        x = self.embedding[rows].sum(1)
        if len(x) < max(WIDTHS):
            x = np.concatenate([x, np.zeros((max(WIDTHS) - len(x), DIM), np.float32)])
        won, pooled = [], []
        for i in range(len(WIDTHS)):
            r = self.responses(x, i)
            won.append(r.argmax(0))
            pooled.append(np.maximum(r[won[i], np.arange(FILTERS)], 0))
        flat = np.concatenate(pooled)
        g = weight * (1 / (1 + np.exp(-np.clip(float(flat @ self.out + self.bias[0]), -30, 30))) - y)
        back = (g * self.out).reshape(len(WIDTHS), FILTERS)
        dx = np.zeros_like(x)
        m = len(WIDTHS)
        for i, k in enumerate(WIDTHS):
            live = np.flatnonzero(pooled[i] > 0)
            if not len(live):
                continue
            at, d = won[i][live][:, None] + np.arange(k), back[i][live]
            bank = self.banks[i][:, :, live]
            np.add.at(dx, at.reshape(-1), (d[:, None, None] * bank.transpose(2, 0, 1)).reshape(-1, DIM))
            grad = np.zeros_like(self.banks[i])
            grad[:, :, live] = (d[:, None, None] * x[at]).transpose(1, 2, 0)
            self._move(self.banks[i], grad, sums[1 + i])
            grad = np.zeros(FILTERS, np.float32)
            grad[live] = d
            self._move(self.biases[i], grad, sums[1 + m + i])
        self._move(self.out, g * flat, sums[1 + 2 * m])
        self._move(self.bias, np.array([g], np.float32), sums[2 + 2 * m])
        touched = np.flatnonzero(dx[: len(rows)].any(1))
        if len(touched):
            bucket, place = np.unique(rows[touched].reshape(-1), return_inverse=True)
            grad = np.zeros((len(bucket), DIM), np.float32)
            np.add.at(grad, place.reshape(-1), np.repeat(dx[touched], 3, axis=0))
            grad[~self.known[bucket]] = 0
            sums[0][bucket] += grad * grad
            self.embedding[bucket] -= RATE * grad / (np.sqrt(sums[0][bucket]) + 1e-6)

    @staticmethod
    def _move(part: np.ndarray, grad: np.ndarray, squares: np.ndarray) -> None:
        squares += grad * grad
        part -= RATE * grad / (np.sqrt(squares) + 1e-6)


def train(rows: list[np.ndarray], labels: list[int], seed: int = 0) -> Net:
    """Classes weigh the same; the order of the texts is drawn anew each epoch, from a fixed seed."""
    net, rng = Net(seed), np.random.default_rng(seed)
    net.start(rows, np.array(labels))
    sums = [np.full_like(p, 0.1 if p.ndim != 2 else 0.02) for p in net.parts()]
    y = np.array(labels)
    weight = {c: len(y) / (2 * max(1, (y == c).sum())) for c in (0, 1)}
    for _ in range(max(EPOCHS, -(-MIN_STEPS // max(1, len(rows))))):
        for i in rng.permutation(len(rows)):
            net.step(rows[i], int(y[i]), weight[int(y[i])], sums)
    return net


def calibrate(counts: np.ndarray) -> float:
    """The threshold with the best F1, by the clean and toxic texts per bin; halfway to the next bin below it, CUT if one class is missing."""
    if not counts.sum(1).all():
        return CUT
    used = np.flatnonzero(counts.sum(0))[::-1]
    hit, all_ = np.cumsum(counts[1, used]), np.cumsum(counts[:, used].sum(0))
    best = int(np.argmax(2 * hit / (all_ + hit[-1])))
    edge = (used[best] + (used[best + 1] + 1 if best + 1 < len(used) else used[best])) / 2
    return float(1 / (1 + np.exp(-(edge - BIN_EDGE) / BINS)))


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = 2_500) -> tuple[bytes, list[int]]:
    """The net's parts as bytes (their size is fixed) and the doc_ids it learnt from: four fifths of the bounded training sample."""
    sample = training_sample(docs, labels, "toxic", max_per_class).filter(F.col("part") != FOLD)

    arrow = arrow_types("net binary, ids array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows, y, ids = Words(), [], [], []
        for batch in batches:
            for doc_id, text, label in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                rows.append(words(text))
                y.append(label)
                ids.append(doc_id)
        if rows:
            yield pa.RecordBatch.from_pylist([{"net": train(rows, y).blob(), "ids": ids}], schema=arrow)

    found = map_arrow(sample, run, "net binary, ids array<long>").collect()
    if not found:  # no label to learn from: every text scores one half
        none = Net()
        none.out[:] = 0
        return none.blob(), []
    return bytes(found[0]["net"]), list(found[0]["ids"])


def thresholds(scored: DataFrame, labels: DataFrame, learnt: list[int]) -> dict[str, float]:
    """A threshold per language with MIN_OWN texts of either class, and '' for all the others.

    They come from all labelled rows that are neither held out nor learnt from. Counts per language, bin and class reach
    the driver.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max("toxic").cast("int").alias("y")
    )
    used = F.broadcast(scored.sparkSession.createDataFrame([(i,) for i in learnt], "_id long"))  # bounded by the sample
    known = known.join(used, "_id", "left_anti")
    at = F.floor(F.ln(F.col("score") / (1 - F.col("score"))) * BINS)
    bins = scored.filter(~F.col("held_out")).join(known, F.col("doc_id") == F.col("_id")).groupBy(
        "lang", "y", F.greatest(F.lit(-BIN_EDGE), F.least(F.lit(BIN_EDGE), at)).cast("int").alias("bin")
    ).count()
    counts: dict[str, np.ndarray] = {}
    for r in bins.collect():
        counts.setdefault(r["lang"], np.zeros((2, 2 * BIN_EDGE + 1), np.int64))[r["y"], r["bin"] + BIN_EDGE] += r["count"]
    every = sum(counts.values(), np.zeros((2, 2 * BIN_EDGE + 1), np.int64))
    return {"": calibrate(every)} | {k: calibrate(n) for k, n in counts.items() if k and n.sum(1).min() >= MIN_OWN}


def load(blob: bytes) -> Net:
    net, at = Net(), 0
    for part in net.parts():
        part[...] = np.frombuffer(blob, np.float32, part.size, at).reshape(part.shape)
        at += 4 * part.size
    return net


def score(docs: DataFrame, blob: bytes) -> DataFrame:
    """(doc_id, held_out, lang, score) of every whole text; null and empty texts get the score of no word at all."""
    shared = docs.sparkSession.sparkContext.broadcast(blob)
    arrow = arrow_types(SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = Words(), load(shared.value)
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(np.array([net.logit(words(t.as_py())) for t in batch.column(1)], np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(p)], schema=arrow)

    columns = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id").cast("long")), F.coalesce(F.col("lang").cast("string"), F.lit(""))
    )
    return map_arrow(columns, run, SCORED)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows not held out and score every row; ``flagged`` holds the score against its language's threshold,
    ``predicted`` against CUT. The language picks the threshold and is no input of the score. Repeated rows score alike; an
    empty table gives none.
    """
    blob, learnt = fit(docs, labels)
    scored = cut_lineage(score(docs, blob))
    cuts = thresholds(scored, labels, learnt)
    own = F.broadcast(docs.sparkSession.createDataFrame(list(cuts.items()), "lang string, cut double"))  # a row per language
    found = scored.join(own, "lang", "left").withColumn("threshold", F.coalesce("cut", F.lit(cuts[""])))
    return found.select(
        "doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged")
    )
