"""A tree of line logs read once: lines, sizes and digests of byte ranges from the same bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import cut_lineage, send_package

FORMAT = "log_tree"
# Bytes of a block, whose digest enters the hash of its file.
BLOCK_BYTES = 128 << 20
# Small files are read together, up to so many bytes or files in a task.
TASK_BYTES, TASK_FILES = 128 << 20, 512
# A longer line can't be one value; its text is null, its length counts.
MAX_LINE_BYTES = 256 << 20
# Bytes read, and lines handed on, at once.
CHUNK_BYTES, BATCH_LINES, BATCH_BYTES = 4 << 20, 10_000, 16 << 20

SCHEMA = "rel_path string, block long, line_in_block long, line string, bytes long, lines long, digest string"
NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]


@dataclass
class Block(InputPartition):
    """One byte range of a file."""

    path: str
    rel_path: str
    start: int
    stop: int


@dataclass
class Blocks(InputPartition):
    """Byte ranges that one task reads."""

    blocks: list[Block]


class LogTreeReader(DataSourceReader):
    """Lists the tree where it is planned; every task opens its own ranges."""

    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.suffix = options["path"], options.get("suffix", ".log")
        self.block_bytes = int(options.get("blockbytes", BLOCK_BYTES))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.max_line = int(options.get("maxlinebytes", MAX_LINE_BYTES))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))

    def partitions(self) -> list[Blocks]:
        from pyarrow.fs import FileSelector

        store, top = self._files()
        top = top.rstrip("/")
        packed, weight = [Blocks([])], 0
        for info in sorted(store.get_file_info(FileSelector(top, recursive=True)), key=lambda i: i.path):
            if not info.is_file or not info.path.endswith(self.suffix):
                continue
            for start in range(0, max(info.size, 1), self.block_bytes):
                block = Block(info.path, info.path[len(top) + 1 :], start, min(start + self.block_bytes, info.size))
                size = block.stop - start
                if packed[-1].blocks and (weight + size > self.task_bytes or len(packed[-1].blocks) >= TASK_FILES):
                    packed.append(Blocks([]))
                    weight = 0
                packed[-1].blocks.append(block)
                weight += size
        return packed

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        store, _ = self._files()
        rows, held = [], 0
        for block in partition.blocks:
            for row in self._block(store, block):
                rows.append(row)
                held += len(row[3] or b"")
                if len(rows) >= BATCH_LINES or held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _block(self, store, block: Block) -> Iterator[tuple]:
        """The lines that start in the range, and then a row for the range itself.

        The last line is read to its end beyond the range, but only the bytes of the range are hashed. A line is held in pieces
        up to the largest line, and beyond that only its length.
        """
        digest, n_lines, pieces, length, open_ = hashlib.sha256(), 0, [], 0, False
        with store.open_input_file(block.path) as file:
            at = block.start
            if at:
                file.seek(at - 1)
                skipping = file.read(1) != b"\n"
            else:
                skipping = False
            while True:
                within = at < block.stop
                if not within and not open_:
                    break
                chunk = file.read(min(CHUNK_BYTES, block.stop - at) if within else CHUNK_BYTES)
                if not chunk:
                    if within:
                        raise OSError(f"{block.path} became shorter while it was read")
                    break
                at += len(chunk)
                if within:
                    digest.update(chunk)
                begin, ended = 0, False
                while begin < len(chunk):
                    end = chunk.find(b"\n", begin)
                    stop = len(chunk) if end < 0 else end
                    if not skipping:
                        open_ = True
                        length += stop - begin
                        if length <= self.max_line:
                            pieces.append(chunk[begin:stop])
                        else:
                            pieces = []
                    if end < 0:
                        break
                    if not skipping:
                        n_lines += 1
                        yield block.rel_path, block.start, n_lines, _line(pieces, length, self.max_line), length, None, None
                        pieces, length, open_ = [], 0, False
                        if not within:
                            ended = True
                            break
                    skipping, begin = False, end + 1
                if ended:
                    break
            if open_:
                n_lines += 1
                yield block.rel_path, block.start, n_lines, _line(pieces, length, self.max_line), length, None, None
        yield block.rel_path, block.start, None, None, block.stop - block.start, n_lines, digest.hexdigest()


def _line(pieces: list[bytes], length: int, most: int) -> bytes | None:
    return b"".join(pieces) if length <= most else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    raw = pa.array(columns[3], pa.binary())
    try:
        text = raw.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8 show as replacement characters
        text = pa.array([None if b is None else b.decode("utf-8", "replace") for b in columns[3]], pa.string())
    kinds = [pa.string(), pa.int64(), pa.int64(), None, pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([text if k is None else pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)


class LogTree(DataSource):
    """``spark.read.format("log_tree").load(root)``: rows of lines (bytes: their length) and of blocks (line_in_block null).

    Options: suffix, blockBytes, taskBytes, maxLineBytes. The root may be a local folder or any address that pyarrow can open.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogTreeReader:
        return LogTreeReader(dict(self.options))


def scan_tree(spark: SparkSession, root: str, **options: int | str) -> tuple[DataFrame, DataFrame]:
    """(files, lines) of ``root/<dataset>/task_<task>/<view>/*.log``, both from one read of the tree.

    ``files``: rel_path, dataset, task, filename, sha256, bytes, lines. ``lines``: rel_path, dataset, task, line_no, line, line_bytes.
    A file of one block has the sha256 of its bytes; a larger one the sha256 of the digests of its blocks in order, so no file is
    hashed, or held, as one value. Empty files are listed. Lines end at ``\\n`` only; a final newline starts no further line. What is
    read is written once in columnar form, blocks and lines, and both results read their columns of that table. Only the
    table of blocks is joined to lines.
    """
    send_package(spark)
    spark.dataSource.register(LogTree)
    reader = spark.read.format(FORMAT)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    table = cut_lineage(reader.load(root))
    blocks = table.filter("line_in_block is null").select("rel_path", "block", "bytes", "lines", "digest")
    ordered = F.array_sort(F.collect_list(F.struct("block", "digest")))
    files = blocks.groupBy("rel_path").agg(F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"), ordered.alias("_b"))
    joined = F.array_join(F.transform("_b", lambda b: b["digest"]), "")
    files = files.withColumn("sha256", F.when(F.size("_b") == 1, F.get("_b", F.lit(0))["digest"]).otherwise(F.sha2(joined, 256)))
    earlier = Window.partitionBy("rel_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("rel_path", "block", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("_before"))
    lines = table.filter("line_in_block is not null").join(before, ["rel_path", "block"])
    parts = F.split("rel_path", "/")
    place = [F.get(parts, F.lit(0)).alias("dataset"), F.regexp_replace(F.get(parts, F.lit(1)), "^task_", "").alias("task")]
    return (
        files.select("rel_path", *place, F.element_at(parts, -1).alias("filename"), "sha256", "bytes", "lines"),
        lines.select("rel_path", *place, (F.col("line_in_block") + F.col("_before")).alias("line_no"), "line", F.col("bytes").alias("line_bytes")),
    )


def write_tree(files: DataFrame, root: str) -> None:
    """Write each row of ``files`` (rel_path, text) as one file below ``root``, from the executors. A null text is an empty file.

    A task that is run again writes the same files again.
    """
    send_package(files.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
        made, count = set(), 0
        for batch in batches:
            for rel_path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = f"{top.rstrip('/')}/{rel_path}"
                folder = place.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(place) as out:
                    out.write((text or "").encode())
                count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    files.select("rel_path", "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()
