"""The bounded sample of labelled documents that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

# Bounds of a training sample: documents per class, characters of one document, and characters of all.
MAX_PER_CLASS = 3_000
MAX_DOC_CHARS = 100_000
MAX_CHARS = 24_000_000


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, text, lang, y, part): labelled rows to learn from, in the order of a hash of doc_id, in one partition.

    Rows held out are never in it, nor those of null label. Of each class the ``max_per_class`` rows with the smallest
    hash are taken, whole texts of MAX_DOC_CHARS or fewer, until MAX_CHARS are reached. ``part`` is 0 to 4.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(label).alias("y")
    )
    known = known.filter(~held_out(F.col("_id"))).withColumn("_hash", F.xxhash64("_id"))
    taken = None
    for y in (0, 1):  # a top-k per class: each task keeps its smallest, none holds a class
        one = known.filter(F.col("y") == y).orderBy("_hash", "_id").limit(2 * max_per_class)
        taken = one if taken is None else taken.unionByName(one)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    short = texts.filter(F.length("text") <= MAX_DOC_CHARS)
    rows = short.join(F.broadcast(taken), F.col("doc_id") == F.col("_id"))  # 4 * max_per_class rows at most
    order = Window.partitionBy("y").orderBy("_hash", "_id", "text")  # over the bounded sample alone
    ranked = rows.withColumn("_rank", F.row_number().over(order)).withColumn("_sum", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.filter((F.col("_rank") <= max_per_class) & (F.col("_sum") <= MAX_CHARS // 2))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)).cast("int").alias("part")
    return kept.select("doc_id", "text", "lang", "y", part, "_hash").repartition(1).sortWithinPartitions("_hash", "doc_id").drop("_hash")
