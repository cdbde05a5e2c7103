"""Log trees: files, numbered lines, and artifact hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _below(spark: SparkSession, path: Column, root: str) -> Column:
    """Path relative to ``root``, cut by the length of the resolved root."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/")
    bare = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(bare, len(top) + 2, 1 << 30)


def decoded(path: Column) -> Column:
    """``_metadata`` gives percent-encoded paths."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def scan_files(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """Inventory of ``root/<dataset>/task_<task>/<view>/*.log``: names, sha256 and size.

    Hashing reads a file as one value, so files must be below 2 GiB; ``scan_lines`` has no such limit.
    File sources skip empty files: a ``listing`` (rel_path) of the tree adds them.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").load(root)
    rel = found.select(_below(spark, F.col("path"), root).alias("rel_path"), F.sha2("content", 256).alias("sha256"), "length")
    if listing is not None:
        rel = listing.select("rel_path").join(rel, "rel_path", "left")
    parts = F.split("rel_path", "/")
    return rel.select(
        "rel_path", F.get(parts, F.lit(0)).alias("dataset"),
        F.regexp_replace(F.get(parts, F.lit(1)), "^task_", "").alias("task"), F.element_at(parts, -1).alias("filename"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"), F.coalesce("length", F.lit(0)).alias("bytes"),
    )


def scan_lines(spark: SparkSession, root: str) -> DataFrame:
    """Numbered lines of all ``*.log`` files: rel_path, dataset, task, line_no, line.

    The text source splits large files into blocks, which tasks read in any order. The lines of a block have
    consecutive ids, so a line's number is its id, less the first id of its block, plus the lines of earlier
    blocks. Only the table of blocks is written and joined; texts stay where they are read as long as that table is
    below the broadcast threshold. Lines end at ``\\n`` only; a final newline starts no further line.
    """
    text = (
        spark.read.option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    )
    rows = text.select(
        _below(spark, decoded(F.col("_metadata.file_path")), root).alias("rel_path"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_order"),
        F.col("value").alias("line"),
    )
    blocks = rows.groupBy("rel_path", "_block").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("rel_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_shift")
    numbered = rows.join(cut_lineage(blocks.select("rel_path", "_block", shift)), ["rel_path", "_block"])
    numbered = numbered.withColumn("line_no", F.col("_order") + F.col("_shift"))
    parts = F.split("rel_path", "/")
    return numbered.select(
        "rel_path", F.get(parts, F.lit(0)).alias("dataset"),
        F.regexp_replace(F.get(parts, F.lit(1)), "^task_", "").alias("task"), "line_no", "line",
    )


def split_text_lines(texts: DataFrame, *keep: str) -> DataFrame:
    """Numbered lines of a text column: ``keep`` columns, line_no, line. A final newline adds no line."""
    lines = F.split(F.regexp_replace("text", "\n\\z", ""), "\n")
    rows = texts.filter("text <> ''").select(*keep, F.posexplode(lines).alias("_pos", "line"))
    return rows.select(*keep, (F.col("_pos") + 1).cast("long").alias("line_no"), "line")


def artifact_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(rel_path, sha256) of every file below ``root``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select(_below(spark, F.col("path"), root).alias("rel_path"), F.sha2("content", 256).alias("sha256"))


def expected_artifacts(expected: DataFrame, hashes: DataFrame) -> DataFrame:
    """Hash of each expected path, null when the file is absent."""
    return expected.select("rel_path").join(hashes, "rel_path", "left")
