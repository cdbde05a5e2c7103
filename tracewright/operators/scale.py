"""Helpers that keep a hot key from ending up in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that share a window partition, for keys ordered by a dense integer.
CHUNK_ROWS = 65_536
# Window partitions a key is spread over when it is ordered by a hash.
HASH_BUCKETS = 1_024


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is evaluated once per row.

    Filters and join keys on a projected column are pushed below the projection, where the optimizer
    repeats its expression. They cannot be pushed below a generator, and exploding a one-element
    array is one.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def row_chunk(position: Column, size: int = CHUNK_ROWS) -> Column:
    """Chunk of a dense integer position. Monotone in ``position``."""
    return F.floor(position / F.lit(size)).cast("long")


def hash_bucket(uniform: Column, buckets: int = HASH_BUCKETS) -> Column:
    """Bucket of a uniform in [0, 1). Monotone in ``uniform``."""
    return F.floor(uniform * F.lit(buckets)).cast("long")


def chunked_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without one task per key.

    ``chunk`` must be monotone in the order, and keys must not be null. Rows are numbered inside
    (keys, chunk); the number of rows in earlier chunks comes from a per-chunk count, which is small.
    The join on (keys, chunk) and the window share one exchange.
    """
    keys = list(keys)
    tagged = df.withColumn("_chunk", chunk)
    counts = tagged.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    joined = tagged.join(offsets, [*keys, "_chunk"])
    return joined.withColumn(name, F.row_number().over(inside) + F.col("_offset")).drop("_chunk", "_offset")


# Levels of dyadic blocks: seconds of all years of four digits fit below 2^39.
DYADIC_LEVELS = 40


def dyadic_cover(start: Column, end: Column) -> Column:
    """Array of (level, block): the fewest aligned blocks of 2^level integers that make up ``start`` to ``end``, both included.

    Two of a level at most, so an interval of ten years of seconds has some tens. A level takes the block at either side that its
    parent would carry beyond the interval.
    """

    def level(width: Column, k: Column) -> Column:
        low = F.floor((start + width - 1 - F.pmod(start + width - 1, width)) / width).cast("long")
        high = F.floor((end + 1 - F.pmod(end + 1, width)) / width).cast("long")
        odd = lambda c: F.pmod(c, F.lit(2)) == 1
        block = lambda c: F.struct(k.cast("int").alias("level"), c.alias("block"))
        return F.array_compact(F.array(F.when((low < high) & odd(low), block(low)), F.when((low < high) & odd(high), block(high - 1))))

    return F.flatten(F.transform(F.array(*[F.lit(1 << k).cast("long") for k in range(DYADIC_LEVELS)]), level))


def in_interval(
    points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: Sequence[str], unit: int = 1
) -> DataFrame:
    """Equi-join of points with the intervals of equal ``keys`` (nulls are equal) that contain them; each pair comes once.

    An interval stands under its few blocks, a point asks for the block of every level that occurs, so the join never meets a pair
    that does not belong together, and one place with many intervals is spread over their blocks. ``points`` and ``intervals`` share
    only the names in ``keys``; those of the intervals are dropped. A coarser ``unit`` has fewer levels, and some pairs are met that
    are then dropped.
    """
    units = lambda c: F.floor(F.col(c) / F.lit(unit)).cast("long")
    held = intervals.filter(F.col(start) <= F.col(end)).withColumn("_block", F.explode(dyadic_cover(units(start), units(end))))
    levels = held.agg(F.array_sort(F.collect_set("_block.level")).alias("_levels"))  # one row of at most DYADIC_LEVELS numbers
    asked = points.withColumn("_at", units(at)).join(levels, F.lit(True)).withColumn("_al", F.explode("_levels"))
    asked = asked.select(*points.columns, "_al", F.expr("shiftright(_at, _al)").alias("_ab"))
    held = held.select(*[F.col(k).alias(f"_i_{k}") for k in keys], *[c for c in intervals.columns if c not in keys],
                       F.col("_block.level").alias("_hl"), F.col("_block.block").alias("_hb"))
    same = (F.col("_al") == F.col("_hl")) & (F.col("_ab") == F.col("_hb"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_i_{k}"))
    met = asked.join(held, same).filter(F.col(at).between(F.col(start), F.col(end)))
    return met.drop("_al", "_ab", "_hl", "_hb", *[f"_i_{k}" for k in keys])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys match, keeping the left key columns once."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])
