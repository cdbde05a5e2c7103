"""A store of token ids coded with a range asymmetric numeral system over one static table.

Layout of a store: ``table`` (token, frequency), shared by all blocks and read first, and ``blocks``, one row per block.
A block is coded on its own in LANES interleaved states. Its checkpoints hold the states and the place in the words at
every CHECKPOINT_STEPS steps, so that its parts are decoded side by side; ``payload_crc32`` covers the words and
checkpoints, ``ids_crc32`` the ids. Rows are Parquet, whose writer commits whole tasks only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_types, map_arrow, scratch
from .tokens import text_ids

SCALE_BITS = 18
LANES = 1024
CHECKPOINT_STEPS = 128
BLOCK_TOKENS = 1 << 18
END_ID = 0
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
STAGED = "doc_id long, n_tokens long, ids binary"
BLOCKS = (
    "shard long, block long, first_token long, n_tokens long, first_doc long, doc_ids array<long>, doc_offsets array<long>,"
    " doc_lengths array<long>, words binary, states binary, places binary, payload_crc32 long, ids_crc32 long"
)
PIECES = "shard long, doc long, doc_id long, first_token long, doc_offset long, length long, crc long"


# --- coder -----------------------------------------------------------------------------------------------------------


def quantise(tokens: np.ndarray, counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of at least one that sum to ``2 ** bits``, near proportional to ``counts``."""
    size = 1 << bits
    if len(tokens) > size:
        raise ValueError("more distinct tokens than slots")
    share = 1 + np.floor(counts / counts.sum() * (size - len(tokens))).astype(np.int64)
    share[np.lexsort((tokens, -counts))[0]] += size - share.sum()
    return share


class Table:
    """Frequencies of the tokens and the token of each slot."""

    def __init__(self, tokens: np.ndarray, frequencies: np.ndarray) -> None:
        order = np.argsort(tokens)
        tokens, frequencies = tokens[order].astype(np.int64), frequencies[order].astype(np.int64)
        size = int(tokens.max()) + 1 if len(tokens) else 1
        self.frequency, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.frequency[tokens] = frequencies
        self.start[tokens] = np.cumsum(frequencies) - frequencies
        self.token = np.repeat(tokens, frequencies).astype(np.int32)


@cache
def _table(tokens: bytes, frequencies: bytes) -> Table:
    return Table(np.frombuffer(tokens, "<i8"), np.frombuffer(frequencies, "<i8"))


def encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, states at the checkpoints, and words before each checkpoint."""
    n, bits = len(ids), np.uint64(SCALE_BITS)
    frequency, start = table.frequency[ids], table.start[ids]
    if n and frequency.min() == 0:
        raise ValueError("a token is not in the table")
    limit = frequency << (np.uint64(31) - bits + WORD_BITS)
    state = np.full(LANES, LOW)
    steps = -(-n // LANES)
    words: list[np.ndarray] = [np.empty(0, "<u4")] * steps
    states, begins = [], range(0, steps, CHECKPOINT_STEPS)
    for step in range(steps - 1, -1, -1):
        a, b = step * LANES, min(n, (step + 1) * LANES)
        x, f = state[: b - a], frequency[a:b]
        full = x >= limit[a:b]
        words[step] = x[full].astype("<u4")
        x = np.where(full, x >> WORD_BITS, x)
        quotient = x // f
        state[: b - a] = (quotient << bits) + (x - quotient * f) + start[a:b]
        if step % CHECKPOINT_STEPS == 0:
            states.append(state.copy())
    before = np.cumsum([0] + [len(w) for w in words])
    places = np.array([before[k] for k in begins], np.int64)
    out = np.concatenate(words) if words else np.empty(0, "<u4")
    return out, np.array(states[::-1], np.uint64).reshape(-1, LANES), places


def decode(n: int, words: np.ndarray, states: np.ndarray, places: np.ndarray, table: Table) -> np.ndarray:
    """The ids of a block; its parts between checkpoints are decoded side by side."""
    bits, mask = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    parts, part = len(places), CHECKPOINT_STEPS * LANES
    out = np.zeros((parts, CHECKPOINT_STEPS, LANES), np.int32)
    state, place = states.copy(), places.copy()
    lane = np.arange(LANES)
    sizes = np.minimum(part, n - part * np.arange(parts))
    words = np.concatenate([words, np.zeros(1, words.dtype)]).astype(np.uint64)
    for step in range(CHECKPOINT_STEPS):
        live = int((sizes > step * LANES).sum())  # only the last part can be shorter
        if not live:
            break
        x = state[:live]
        slot = x & mask
        token = table.token[slot.astype(np.int64)]
        x = table.frequency[token] * (x >> bits) + slot - table.start[token]
        low = x < LOW
        if sizes[live - 1] < (step + 1) * LANES:
            done = lane >= sizes[live - 1] - step * LANES
            low[live - 1, done] = False
            x[live - 1, done] = state[live - 1, done]
        out[:live, step] = token
        taken = low.sum(1)
        at = np.arange(int(taken.sum())) + np.repeat(place[:live] - (np.cumsum(taken) - taken), taken)
        x[low] = (x[low] << WORD_BITS) | words[at]
        place[:live] += taken
        state[:live] = x
    return out.reshape(-1)[:n]


# --- checksums of documents that span blocks -------------------------------------------------------------------------

POLYNOMIAL = 0xEDB88320  # fixed value: the reflected polynomial of CRC-32


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's, bits reflected."""
    product = 0
    for bit in range(31, -1, -1):
        if (a >> bit) & 1:
            product ^= b
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return product


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings joined, from their own and the length of the second."""
    shift, power, n = 1 << 31, 1 << 23, second_bytes  # x ** 0 and x ** 8
    while n:
        if n & 1:
            shift = _times(shift, power)
        power, n = _times(power, power), n >> 1
    return _times(first, shift) ^ second


# --- writing ---------------------------------------------------------------------------------------------------------


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of every whole text with the end id, as compressed 16-bit integers."""
    schema = arrow_types(STAGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, pack = text_ids(tokenizer, 2), zstandard.ZstdCompressor(level=1).compress
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            raw = [ids_of(t.as_py()) + end for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) // 2 for r in raw], pa.int64()), pa.array([pack(r) for r in raw])], schema=schema
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, STAGED)


def _unpack(binary: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(binary), "<u2")


def count_tokens(staged: DataFrame) -> DataFrame:
    """(token, count) over all ids; each task sums before the shuffle."""
    schema = arrow_types("token long, count long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << 16, np.int64), [], 0
        for ids in (v.as_py() for batch in batches for v in batch.column(0)):
            held.append(_unpack(ids))
            size += len(held[-1])
            if size > 1 << 20:
                total, held, size = total + np.bincount(np.concatenate(held), minlength=1 << 16), [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << 16)
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(total[token])], schema=schema)

    return map_arrow(staged.select("ids"), run, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))


def _coded(shard: int, block: int, first: int, first_doc: int, docs: list[tuple], ids: np.ndarray, table: Table) -> tuple:
    words, states, places = encode(ids.astype(np.int64), table)
    payload = words.tobytes(), states.astype("<u8").tobytes(), places.astype("<i8").tobytes()
    check = zlib.crc32(payload[2], zlib.crc32(payload[1], zlib.crc32(payload[0])))
    return (
        shard, block, first, len(ids), first_doc, [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs],
        *payload, check, zlib.crc32(ids.astype("<u4")),
    )


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of all ``docs`` in ascending doc_id order (nulls first, repeated rows by their ids) to ``path``.

    Ids are computed once and staged. Shards are ranges of doc_id; a task holds the ids of one block. Documents
    longer than a block go on in the next. The table has an entry per token of the vocabulary at most.
    """
    spark = docs.sparkSession
    staged = cut_lineage(tokenise(docs, tokenizer, end_id))
    counts = sorted((r["token"], r["count"]) for r in count_tokens(staged).collect())  # bounded by 2 ** 16 ids
    tokens = np.array([t for t, _ in counts], np.int64)
    shares = quantise(tokens, np.array([c for _, c in counts], np.int64)) if counts else tokens
    spark.createDataFrame(list(zip(tokens.tolist(), shares.tolist(), strict=True)), "token long, frequency long").coalesce(
        1
    ).write.parquet(f"{path}/table")
    key = tokens.astype("<i8").tobytes(), shares.astype("<i8").tobytes()
    schema = arrow_types(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard, block, first, first_doc, n_docs = _table(*key), 0, 0, 0, 0, 0
        held: list[np.ndarray] = []
        index: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, first_doc, size
            row = _coded(shard, block, first, first_doc, index, np.concatenate(held), table)
            block, first, size = block + 1, first + size, 0
            held.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                shard, doc_id, ids = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), _unpack(batch.column(2)[i].as_py())
                at = 0
                while at < len(ids):
                    if not index:
                        first_doc = n_docs
                    n = min(len(ids) - at, BLOCK_TOKENS - size)
                    held.append(ids[at : at + n])
                    index.append((doc_id, at, n))
                    at, size = at + n, size + n
                    if size == BLOCK_TOKENS:
                        yield flush()
                n_docs += 1
        if index:
            yield flush()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = staged.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    numbered = ordered.select(F.spark_partition_id().cast("long").alias("shard"), "doc_id", "ids")
    map_arrow(numbered, run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


# --- reading ---------------------------------------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    """The table of a store; its size is bounded by the vocabulary."""
    rows = sorted(map(tuple, spark.read.parquet(f"{path}/table").collect()))
    return tuple(np.array([r[i] for r in rows], "<i8").tobytes() for i in (0, 1))


def block_ids(row: dict, table: Table) -> np.ndarray:
    """Decode one block and check it."""
    check = zlib.crc32(row["places"], zlib.crc32(row["states"], zlib.crc32(row["words"])))
    if check != row["payload_crc32"]:
        raise ValueError(f"block {row['shard']}/{row['block']}: damaged payload")
    states = np.frombuffer(row["states"], "<u8").astype(np.uint64).reshape(-1, LANES)
    ids = decode(row["n_tokens"], np.frombuffer(row["words"], "<u4"), states, np.frombuffer(row["places"], "<i8").astype(np.int64), table)
    ids = ids.astype("<u4")
    if zlib.crc32(ids) != row["ids_crc32"]:
        raise ValueError(f"block {row['shard']}/{row['block']}: wrong ids")
    return ids


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of documents with the checksum of their ids, from blocks decoded independently of one another."""
    key, schema = read_table(spark, path), arrow_types(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(*key)
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = block_ids(row, table)
                n = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(n)
                crcs = [zlib.crc32(ids[b - k : b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = (
                    np.full(len(n), row["shard"]), row["first_doc"] + np.arange(len(n)), row["doc_ids"],
                    row["first_token"] + ends - n, row["doc_offsets"], n, crcs,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return map_arrow(spark.read.parquet(f"{path}/blocks"), run, PIECES)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store, in no order.

    ``start`` counts the ids of all documents before; sums per shard give it. A document that spans blocks has its
    pieces' checksums joined; their number is bounded by its length.
    """
    pieces = cut_lineage(read_pieces(spark, path))
    totals = pieces.groupBy("shard").agg(F.sum("length").alias("_size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    shards = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    spans = pieces.groupBy("shard", "doc").agg(
        F.max("doc_id").alias("doc_id"), F.min("first_token").alias("first_token"), F.sum("length").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("doc_offset", "length", "crc"))).alias("parts"),
    )

    @F.udf("long")
    def joined(parts):
        crc = parts[0]["crc"]
        for part in parts[1:]:
            crc = crc32_joined(crc, part["crc"], 4 * part["length"])
        return crc

    crc = F.when(F.size("parts") == 1, F.col("parts")[0]["crc"])
    whole = spans.filter(F.size("parts") == 1).withColumn("ids_crc32", crc)
    split = spans.filter(F.size("parts") > 1).withColumn("ids_crc32", joined("parts"))
    both = whole.unionByName(split).join(shards, F.col("shard") == F.col("_shard"))
    return both.select("doc_id", (F.col("first_token") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and return what reading it back gives.

    Null and empty texts hold the end id alone; an empty table makes an empty store.
    """
    path = scratch(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
