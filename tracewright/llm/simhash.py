"""SimHash near-duplicates found through the anchor points of a covering code."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_types, map_arrow, smallest_reachable

SHINGLE_WORDS = 4
HASH_SEED = 42
THRESHOLD = 4
# Three blocks of a fingerprint (bits from, bits to); each is read as a word of the code, padded with zeros.
BLOCKS = ((0, 22), (22, 43), (43, 64))
# The perfect binary code of length 23, dimension 12 and covering radius 3, by its generator polynomial.
CODE_LENGTH, CODE_CHECKS, CODE_RADIUS, GENERATOR = 23, 11, 3, 0b101011100011
# Links of two fingerprints have THRESHOLD bits in three blocks, so the two closest blocks share no more than this.
PAIR_THRESHOLD = THRESHOLD * 2 // 3


def fingerprint(text: str | None) -> int:
    """Majority of the bits of the shingles' XXH64; zero for a text without a word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[: 1 - SHINGLE_WORDS], ends[SHINGLE_WORDS - 1 :]
    total, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, total, 65_536):  # a slice of shingles at a time, whatever the length of the text
        pairs = zip(starts[at : at + 65_536].tolist(), stops[at : at + 65_536].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in pairs], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int32)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, key): the fingerprint of every whole text as a signed long, and a hash that tells texts of one doc_id apart."""
    schema = arrow_types("doc_id long, fp long, key long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], schema=schema)

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key())
    return map_arrow(columns, run, "doc_id long, fp long, key long")


def text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _checks(words: np.ndarray) -> np.ndarray:
    """Remainder of each word modulo the generator: its coset of the code."""
    left = words.copy()
    for bit in range(CODE_LENGTH - 1, CODE_CHECKS - 1, -1):
        left ^= np.where((left >> bit) & 1, GENERATOR << (bit - CODE_CHECKS), 0)
    return left


@cache
def _differences() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differences to the anchors by coset: row offsets, difference, and distance beyond the radius.

    A word's anchors within radius + PAIR_THRESHOLD are the word xor each difference of its coset.
    The nearest, within the radius, comes first; a perfect code has exactly one such anchor.
    """
    found = []
    for weight in range(CODE_RADIUS + PAIR_THRESHOLD + 1):
        bits = np.array(list(combinations(range(CODE_LENGTH), weight)), np.int64).reshape(math.comb(CODE_LENGTH, weight), weight)
        found.append(((1 << bits).sum(1).astype(np.int64), np.full(len(bits), max(0, weight - CODE_RADIUS))))
    diff, beyond = np.concatenate([d for d, _ in found]), np.concatenate([b for _, b in found])
    coset = _checks(diff)
    order = np.lexsort((diff, beyond, coset))
    return np.searchsorted(coset[order], np.arange((1 << CODE_CHECKS) + 1)), diff[order], beyond[order]


def _block_anchors(fps: np.ndarray, block: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, distance beyond the radius) of each fingerprint's anchors in one block."""
    offsets, diff, beyond = _differences()
    low, high = block
    words = ((fps >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)
    coset = _checks(words)
    n = offsets[coset + 1] - offsets[coset]
    row = np.repeat(np.arange(len(fps)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[coset], n)
    return row, words[row] ^ diff[at], beyond[at]


def anchors(fps: np.ndarray, threshold: int = PAIR_THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, home): each fingerprint's anchors in the three pairs of blocks, home anchors alone for a threshold of 0.

    An anchor of a pair is an anchor of either block. Every fingerprint has one home anchor per pair, within
    the radius of both blocks, and is replicated to all anchors within radius plus threshold, the threshold
    of a pair being shared by its blocks.
    """
    by_block = [_block_anchors(fps, b) for b in BLOCKS]
    rows, keys, homes = [], [], []
    for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        (r1, a1, b1), (r2, a2, b2) = by_block[i], by_block[j]
        first = np.searchsorted(r2, np.arange(len(fps) + 1))
        for spent in range(threshold + 1):
            left = b1 == spent
            r, a, n = r1[left], a1[left], (first[1:] - first[:-1])[r1[left]]
            row = np.repeat(r, n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[r], n)
            near = b2[at] + spent <= threshold
            rows.append(row[near])
            keys.append((np.int64(k) << 48) | (np.repeat(a, n)[near] << 24) | a2[at[near]])
            homes.append((b2[at[near]] == 0) & (spent == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def anchor_rows(distinct: DataFrame, threshold: int) -> DataFrame:
    """(key, fp) for each distinct ``fp``; the number of rows per fingerprint does not depend on the data's size."""
    schema = arrow_types("key long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                fps = batch.column(0).slice(at, 2_000).to_numpy(zero_copy_only=False)
                row, key, _ = anchors(fps.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], schema=schema)

    return map_arrow(distinct.select("fp"), run, "key long, fp long")


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) with a < b: every two distinct fingerprints that differ in ``threshold`` bits or fewer.

    Of two linked fingerprints some pair of blocks differs in PAIR_THRESHOLD bits or fewer. In it, the home anchor
    of a is within radius + PAIR_THRESHOLD of b, so b is replicated to it and compared there with those at home.
    A pair can come once per pair of blocks. Copies share a fingerprint and never make pairs.
    """
    if threshold > THRESHOLD:
        raise ValueError(f"the blocks are laid out for a threshold of {THRESHOLD} at most")
    home = anchor_rows(distinct, 0).withColumnRenamed("fp", "a")
    guests = anchor_rows(distinct, PAIR_THRESHOLD).withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # neither side is small, whatever its estimate; a sorted merge spills, and hot anchors are split at run time
    return home.hint("merge").join(guests, "key").filter(near).select("a", "b")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, key, class, component_id): ``near_duplicates`` with the text's key and the component's smallest fingerprint."""
    found = cut_lineage(fingerprints(docs))
    distinct = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    spread = distinct.repartition(distinct.sparkSession.sparkContext.defaultParallelism * 4, "fp")
    edges = cut_lineage(links(spread).distinct())
    classes = smallest_reachable(edges).withColumnRenamed("node", "fp")
    named = distinct.join(classes, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("class"))
    smallest = named.groupBy("class").agg(F.min("first").alias("component_id"))
    by_fp = named.join(smallest, "class").select("fp", "class", "component_id")
    return found.join(by_fp, "fp").select("doc_id", "fp", "key", "class", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): one row per document, the component by its smallest doc_id.

    Fingerprints are computed once and written; copies are folded to one row before anything is replicated.
    Null and empty texts have fingerprint zero and link like any other. Repeated rows of a doc_id each come
    back. A null doc_id takes part and never names a component unless no other id is in it. An empty table gives no row.
    """
    return grouped(docs).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, keep_unnamed: bool = True) -> DataFrame:
    """One row of each component: that of the smallest doc_id, and of its texts the one with the smallest key.

    A row is known by its doc_id and text, so unlike texts of one doc_id go with their own groups. Rows without a doc_id
    come last in their component; with ``keep_unnamed`` one of them stays beside the one that has an id.
    """
    return stay(docs, grouped(docs), keep_unnamed)


def stay(docs: DataFrame, classes: DataFrame, keep_unnamed: bool) -> DataFrame:
    """The rows of ``docs`` that stand for their class in ``classes`` (doc_id, key, class)."""
    unnamed = F.col("doc_id").isNull()
    first = F.min(F.struct(unnamed.alias("unnamed"), F.col("doc_id").alias("id"), F.col("key").alias("key"))).alias("first")
    per = ["class", unnamed.alias("_unnamed")] if keep_unnamed else ["class"]
    chosen = classes.groupBy(*per).agg(first).select(F.col("first.id").alias("_keep"), F.col("first.key").alias("_key"))
    chosen = cut_lineage(chosen)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_keep")) & (text_key() == F.col("_key"))
    # whole rows are ranked only where a row is repeated, which the ids and keys alone tell
    repeats = classes.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("_rows")).withColumnsRenamed({"doc_id": "_id", "key": "_text"})
    chosen = cut_lineage(chosen.join(repeats, F.col("_keep").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text"))).select("_keep", "_key", "_rows"))
    held = docs.join(chosen, same)
    once = held.filter("_rows = 1").select(*docs.columns)
    more = held.filter("_rows > 1").dropDuplicates(["_keep", "_key"]).select(*docs.columns)
    return once.unionByName(more)
