"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import gapless_rank


def rendezvous(key: str | Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, at which a record key scores best.

    A key draws a uniform per shard from a hash of both; the smallest exponential with the shard's weight as rate wins,
    so a shard's share is its weight's. A new shard takes only the keys it wins and moves no other. Shards of weight
    zero get nothing. A null key is a key.
    """
    if not any(w > 0 for w in weights) or min(weights) < 0:
        raise ValueError("weights must be non-negative, one of them positive")
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    draws = [
        F.struct((-F.log((F.shiftrightunsigned(F.xxhash64(text, F.lit(s)), 11) + 0.5) / float(1 << 53)) / w).alias("cost"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, by the law of keys.

    ``grown`` are the weights with more shards. Slots count a shard's rows from 0 without a gap. Null texts have no byte.
    Repeated rows share a shard and have a slot each; an empty table gives no row. Texts are read once and never shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = rows.withColumns(
        {"law": F.lit("key"), "shard": rendezvous("doc_id", weights).cast("int"), "grown_shard": rendezvous("doc_id", grown).cast("int")}
    )
    ranked = gapless_rank(cut_lineage(placed), "shard", ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
