"""Alignment of the tokens of two tokenizers by sparse token-byte incidence matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_arrow
from .tokens import byte_level

# Texts that a worker encodes at once.
TEXTS_AT_ONCE = 64
# Link kinds: by shared bytes, by a shared group, by a shared end.
KINDS = ("overlap", "group", "end")
# Pairs of a task's own count table that are held before it is compacted.
COMPACT_AT = 2_000_000


# --- sparse matrices -------------------------------------------------------------------------------------------------


@dataclass
class CSR:
    """Compressed rows: the columns and values of row i are at starts[i] to starts[i + 1]."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def transposed(self) -> CSR:
        """Rows and columns exchanged, by a counting sort of the columns."""
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        starts = np.zeros(self.width + 1, np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.width), out=starts[1:])
        return CSR(starts, rows[order], self.values[order], len(self.starts) - 1)


def byte_incidence(ends: np.ndarray, n_bytes: int) -> CSR:
    """Tokens by bytes: a row holds the bytes of its token, which follow those of the token before."""
    starts = np.concatenate([np.zeros(1, np.int64), ends])
    return CSR(starts, np.arange(n_bytes), np.ones(n_bytes, np.int64), n_bytes)


def end_incidence(ends: np.ndarray, n_bytes: int) -> CSR:
    """Tokens by end offsets: one entry per row."""
    return CSR(np.arange(len(ends) + 1), ends, np.ones(len(ends), np.int64), n_bytes + 1)


def group_incidence(ends: np.ndarray, cuts: np.ndarray) -> CSR:
    """Tokens by groups: the group of a token is the first common cut at or after its end."""
    groups = np.searchsorted(cuts, ends)
    return CSR(np.arange(len(ends) + 1), groups, np.ones(len(ends), np.int64), len(cuts))


def row_products(left: CSR, right: CSR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the non-zero entries of left times right, by Gustavson's row products.

    Row i of the product is the sum of the rows of ``right`` named by the columns of row i of ``left``. All such rows are laid out
    one after the other, and entries that meet in a cell are added.
    """
    rows = np.repeat(np.arange(len(left.starts) - 1), np.diff(left.starts))
    sizes = np.diff(right.starts)[left.columns]
    first = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(first - right.starts[left.columns], sizes)
    row, column = np.repeat(rows, sizes), right.columns[at]
    value = np.repeat(left.values, sizes) * right.values[at]
    cell = row * right.width + column
    if len(cell) > 1 and not (cell[1:] > cell[:-1]).all():
        if not (cell[1:] >= cell[:-1]).all():
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order], value[order]
        new = np.concatenate([[True], cell[1:] != cell[:-1]])
        value, cell = np.add.reduceat(value, np.flatnonzero(new)), cell[new]
        row, column = np.divmod(cell, right.width)
    return row, column, value


# --- one text --------------------------------------------------------------------------------------------------------


class Aligner:
    """Both tokenizers of a pair, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = byte_level(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)
        ]
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in table], np.int64) for table in (self.a.bytes, self.bytes_b))
        self.width_b = len(self.bytes_b)
        # each id as text, followed by one of the marks that can come after it
        self.words = [f"{i}{mark}".encode() for mark in ",|" for i in range(len(self.a.bytes))]
        self.words += [f"{i}{mark}".encode() for mark in ",;" for i in range(self.width_b)]
        self.first_b = 2 * len(self.a.bytes)

    def texts(self, texts: list[str | None]) -> Iterator[Aligned | None]:
        """Alignment of each text; None for a null or empty one and where the tokens don't spell space and text."""
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            some = texts[start : start + TEXTS_AT_ONCE]
            pieces = self.b.encode([t or "" for t in some], num_threads=1)
            for text, ids_b in zip(some, pieces):
                if not text:
                    yield None
                    continue
                spaced = " " + text
                ids_a, raw = self.a.encode(spaced), spaced.encode()
                same = self.a.decode(ids_a) == raw and b"".join(map(self.bytes_b.__getitem__, ids_b)) == raw
                yield Aligned(self, np.array(ids_a, np.int64), np.array(ids_b, np.int64), len(raw)) if same else None


class Aligned:
    """Tokens of one text by both tokenizers, and where they end together."""

    def __init__(self, pair: Aligner, ids_a: np.ndarray, ids_b: np.ndarray, n_bytes: int) -> None:
        self.pair, self.ids_a, self.ids_b, self.n_bytes = pair, ids_a, ids_b, n_bytes
        self.ends_a, self.ends_b = np.cumsum(pair.lengths_a[ids_a]), np.cumsum(pair.lengths_b[ids_b])
        self.at_a, self.at_b, _ = self.links("end")
        self.cuts = self.ends_a[self.at_a]

    def links(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the A token, place of the B token, weight): bytes or groups shared, or ends met."""
        if kind == "group":
            left, right = group_incidence(self.ends_a, self.cuts), group_incidence(self.ends_b, self.cuts)
        else:
            incidence = byte_incidence if kind == "overlap" else end_incidence
            left, right = incidence(self.ends_a, self.n_bytes), incidence(self.ends_b, self.n_bytes)
        return row_products(left, right.transposed())

    def written_groups(self) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, in order."""
        last_a, last_b = np.zeros(len(self.ids_a), np.int64), np.zeros(len(self.ids_b), np.int64)
        last_a[self.at_a] = last_b[self.at_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b, through_a = np.concatenate([[0], self.at_b + 1]), self.at_a + 1
        order = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        order[np.arange(len(self.ids_a)) + before_b[group_a]] = self.ids_a + last_a * len(self.pair.a.bytes)
        order[np.arange(len(self.ids_b)) + through_a[group_b]] = self.ids_b + last_b * self.pair.width_b + self.pair.first_b
        return b"".join(map(self.pair.words.__getitem__, order.tolist()))[:-1]


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process and pair of vocabularies."""
    return Aligner(path_a, path_b)


# --- operators -------------------------------------------------------------------------------------------------------

PART = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, counts array<int>"


def _key_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def token_links(docs: DataFrame, path_a: str, path_b: str, kind: str = "overlap") -> DataFrame:
    """doc_id, a_at, b_at, a_id, b_id, weight: the links of every text, one row each.

    ``kind``: ``overlap`` (weight: shared bytes), ``group`` (all pairs of a group) or ``end`` (byte ranges that end together).
    Texts that are null, empty or not spelt by both token sequences have none. Repeated rows are linked again.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    schema = f"doc_id {_key_type(docs)}, a_at long, b_at long, a_id long, b_id long, weight long"
    names = ["doc_id", "a_at", "b_at", "a_id", "b_id", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = aligner(path_a, path_b)
        for batch in batches:
            for i, found in enumerate(pair.texts(batch.column(1).to_pylist())):
                if found is not None:
                    a, b, weight = found.links(kind)
                    ids = batch.column(0).take(pa.array(np.full(len(a), i)))
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (a, b, found.ids_a[a], found.ids_b[b], weight))], names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text).

    A is a byte-level vocabulary file, which encodes space and text; B a model file that adds the space. Texts that are null,
    empty or not spelt by both token sequences have no tokens. A pair's count is the number of links of the whole corpus that
    hold it; repeated rows count again, and ties for the highest count of a B id are all best. Extra columns are left out.

    Two tokens can end together only if the bytes of one end in those of the other, so there are at most as many pairs as
    the bytes of both vocabularies together: the table of counts is bounded by the vocabularies, whatever the corpus, and
    every task gets it. Links stay with their text.
    """
    kind = _key_type(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = aligner(path_a, path_b)
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            starts, keys, counts = [0], [], []
            for found in pair.texts(batch.column(1).to_pylist()):
                row = (0, 0, 0, 0, "")
                if found is not None:
                    pairs = found.ids_a[found.at_a] * pair.width_b + found.ids_b[found.at_b]
                    some, often = np.unique(pairs, return_counts=True)
                    keys.append(some)
                    counts.append(often)
                    digest = hashlib.sha256(found.written_groups()).hexdigest()
                    row = (len(found.ids_a), len(found.ids_b), len(found.cuts), len(found.at_a), digest)
                starts.append(starts[-1] + (len(keys[-1]) if found is not None else 0))
                for column, value in zip(columns, row):
                    column.append(value)
            offsets = pa.array(starts, pa.int32())
            keys, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(keys)), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "counts"],
            )

    parts = cut_lineage(map_arrow(docs.select("doc_id", "text"), encode, PART.format(kind=kind)))
    table = parts.sparkSession.sparkContext.broadcast(pair_counts(parts, aligner(path_a, path_b)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, best = table.value
        for batch in batches:
            keys, often = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (6, 7))
            sizes = np.asarray(pc.list_value_length(batch.column(6)))
            at = np.searchsorted(known, keys)
            sums = []
            for values in (often * best[at], often * total[at]) if len(keys) else (np.zeros(0, np.int64),) * 2:
                running = np.concatenate([[0], np.cumsum(values)])
                stops = np.cumsum(sizes)
                sums.append(pa.array((running[stops] - running[stops - sizes]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *sums, batch.column(5)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    counted = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return map_arrow(parts, count, counted)


def pair_counts(parts: DataFrame, pair: Aligner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pair keys with their counts over the corpus, and 1 where the count is the highest of the pair's B id.

    Tasks count their own pairs first. What reaches the driver has at most as many rows as both vocabularies have bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            k, c = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            keys.append(k)
            counts.append(c.astype(np.int64))
            held += len(k)
            if held > COMPACT_AT:
                one, n = _added(keys, counts)
                keys, counts, held = [one], [n], len(one)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(keys, counts)], ["key", "n"])

    found = map_arrow(parts.select("keys", "counts"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key")
    rows = found.toArrow()
    keys, counts = rows["key"].to_numpy(), rows["n"].to_numpy()
    bound = int(pair.lengths_a.sum() + pair.lengths_b.sum())
    if len(keys) > bound:
        raise ArithmeticError(f"{len(keys)} pairs, though no more than {bound} can end together")
    highest = np.zeros(pair.width_b, np.int64)
    np.maximum.at(highest, keys % pair.width_b, counts)
    return keys, counts, (counts == highest[keys % pair.width_b]).astype(np.int64)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    some, at = np.unique(np.concatenate(keys), return_inverse=True)
    return some, np.bincount(at, np.concatenate(counts), len(some)).astype(np.int64)
