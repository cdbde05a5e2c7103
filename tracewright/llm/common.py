"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut_lineage, shared_dir

# Bytes of words that all tables of a Python worker remember together, twice over, and what an entry takes besides its text.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 130
# Longer words are computed each time, so that the memory of a cache is bounded.
CACHE_WORD_CHARS = 64
# Rows of a batch that a Python worker holds.
BATCH_ROWS = 1_000
# A ranked group is dealt to chunks of about this many rows.
RANK_CHUNK_ROWS = 20_000


def word_list(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 bytes; none for null."""
    return text.encode().split() if text else []


def map_rows(df: DataFrame, schema: str, row: Callable[..., list[tuple]]) -> DataFrame:
    """Apply ``row`` (a row's values to a list of tuples) to ``df``, batch by batch, without a shuffle."""
    arrow_schema = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                out += row(*(c[i].as_py() for c in batch.columns))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t[k] for t in out], f.type) for k, f in enumerate(arrow_schema)], schema=arrow_schema
            )

    return map_arrow(df, run, schema)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow``, with the package sent to the executors once per application."""
    context = df.sparkSession.sparkContext
    package = Path(__file__).resolve().parents[1]
    if package.is_dir() and getattr(context, "_tracewright_sent", None) is None:
        path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # the driver serves it, executors fetch it
        with zipfile.ZipFile(path, "w") as archive:
            for source in sorted(package.rglob("*.py")):
                archive.write(source, source.relative_to(package.parent))
        context.addPyFile(str(path))
        context._tracewright_sent = str(path)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    owner = f"{run.__module__}.{run.__qualname__}"

    def claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Remembered.claim(owner)
        yield from run(batches)

    return df.mapInArrow(claimed, schema)


def arrow_types(schema: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string."""
    return to_arrow_schema(StructType.fromDDL(schema))


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def gapless_rank(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Dense position from 0 of each row within ``key``, in chunks that spread a hot key.

    The rows of a key are dealt to chunks by a hash of ``order``, whose number follows the number of rows,
    ordered by chunk and then by ``order``. Only a count per chunk crosses chunks. Rows equal in ``order``
    share a chunk and come in any order. A null key is a key of its own.
    """
    chunks = max(1, df.count() // RANK_CHUNK_ROWS)
    tagged = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = tagged.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_key", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    numbered = tagged.withColumn("_inside", F.row_number().over(inside))
    joined = numbered.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_of")))
    return joined.withColumn(name, (F.col("_inside") - 1 + F.col("_before")).cast("long")).select(*df.columns, name)


def smallest_reachable(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches, by contraction.

    A round hooks every node to its smallest neighbour, flattens the trees by pointer jumping, and keeps the edges that
    still join two trees, so a dense group is down to one node after a round. A hub costs no hot task: minima are combined
    before the shuffle, and joins have one row per node on one side. Every step is written to the shared folder.
    """
    edges, roots = cut_lineage(edges.filter("a <> b").select("a", "b")), None
    for _ in range(max_rounds):
        both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))
        parent = edges.select(F.explode(both).alias("e")).groupBy("e.node").agg(F.min("e.to").alias("to"))
        parent = cut_lineage(parent.select("node", F.least("node", "to").alias("up")))
        for _ in range(max_rounds):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = cut_lineage(
                parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            )
            if parent.filter("moved").limit(1).count() == 0:
                break
            parent = parent.select("node", "up")
        tree = parent.select("node", "up")
        if roots is None:
            roots = tree.select("node", F.col("up").alias("root"))
        else:
            above = tree.select(F.col("node").alias("root"), "up")
            roots = cut_lineage(roots.join(above, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        first = edges.join(tree.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").select("x", "b")
        moved = first.join(tree.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").filter("x <> y")
        edges = cut_lineage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.limit(1).count() == 0:
            return roots
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


class Remembered(dict):
    """Values of words, made once and remembered in two generations, so that frequent words are not forgotten.

    All tables of a worker share one budget and change generations together, and a worker that turns to another operator
    forgets the tables of the last one.
    """

    tables: weakref.WeakSet = weakref.WeakSet()
    held = 0
    owner: str | None = None

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make, self.old = make, {}
        Remembered.tables.add(self)

    def __hash__(self) -> int:
        return id(self)

    def __eq__(self, other: object) -> bool:
        return self is other

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= CACHE_WORD_CHARS:
            Remembered.held += ENTRY_BYTES + len(word) + len(value)
            if Remembered.held > CACHE_BYTES:
                for table in Remembered.tables:
                    table.old = dict(table)
                    table.clear()
                Remembered.held = 0
            self[word] = value
        return value

    @classmethod
    def claim(cls, owner: str) -> None:
        """The worker begins a partition of ``owner``."""
        if cls.owner not in (None, owner):
            for table in cls.tables:
                table.old = {}
                table.clear()
            cls.held = 0
            pa.default_memory_pool().release_unused()
        cls.owner = owner


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
