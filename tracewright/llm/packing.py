"""Packing of documents into training sequences: shortest pack first, over the histogram of lengths."""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_types, gapless_rank, map_arrow, map_rows
from .tokens import text_ids

MAX_TOKENS = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``max_tokens`` ids and one shorter rest of every whole document, its end id included."""

    def cut(doc_id, text) -> list[tuple]:
        ids = memoryview(text_ids(tokenizer)(text) + struct.pack("<I", end_id))
        total = len(ids) // 4
        spans = [(a, min(max_tokens, total - a)) for a in range(0, total, max_tokens)]
        return [(doc_id, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]), total) for a, n in spans]

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), PIECES, cut)


def pack_lengths(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that use up ``histogram`` (length to count).

    Lengths are placed longest first. Each goes to the patterns with the smallest sum so far, if it fits there, and
    opens patterns of its own else. Patterns are counted, not listed: placing fewer pieces than a pattern has copies
    splits its count. Work and result depend on the number of lengths, not of documents.
    """
    open_: list[tuple[int, int, tuple[int, ...]]] = []  # (sum, -count, lengths), the smallest sum on top
    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left:
            if open_ and open_[0][0] + length <= max_tokens:
                filled, copies, lengths = heapq.heappop(open_)
                taken = min(left, -copies)
                if -copies > taken:
                    heapq.heappush(open_, (filled, copies + taken, lengths))
            else:
                filled, taken, lengths = 0, left, ()
            left -= taken
            grown = (filled + length, -taken, (*lengths, length))
            heapq.heappush(open_, grown)
    return [(-copies, lengths) for _, copies, lengths in sorted(open_, key=lambda p: (p[2], p[1]))]


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Ranges of ranks: pieces of ``length`` with rank from ``rank`` on take ``sequence + rank difference`` at ``offset``."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for copies, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + copies
            offset += length
        sequence += copies
    rows.sort()
    names = ("length", "rank", "sequence", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def place(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset``: the pieces of a sequence fill it without a gap from 0 on.

    The driver sees the histogram (``max_tokens`` rows at most) and computes the patterns. Patterns meet pieces by
    the rank of a piece among those of its length, found in a table whose size depends on the lengths alone.
    """
    ranked = gapless_rank(pieces, "length", ["doc_id", "start", "ids_crc32"], "_rank")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = _slots(pack_lengths(histogram, max_tokens))
    schema = f"{PIECES}, sequence_id long, offset long"
    arrow = arrow_types(schema)

    def run(batches):
        lengths = np.unique(slots["length"])
        base = np.searchsorted(slots["length"], lengths), np.searchsorted(slots["length"], lengths, "right")
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            at = np.empty(len(rank), np.int64)
            for k in np.unique(length):
                i = np.searchsorted(lengths, k)
                low, high = base[0][i], base[1][i]
                of = length == k
                at[of] = low + np.searchsorted(slots["rank"][low:high], rank[of], "right") - 1
            sequence = slots["sequence"][at] + rank - slots["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(slots["offset"][at])], schema=arrow
            )

    return map_arrow(ranked, run, schema)


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone. A null doc_id is kept. Rows that repeat a doc_id are
    packed each for itself. Ties of rank can only be between equal pieces. An empty table gives no row.
    A sequence is padded to ``max_tokens`` unless its sum is a power of two.
    """
    return place(cut_lineage(cut_documents(docs, tokenizer, max_tokens, end_id)), max_tokens)
